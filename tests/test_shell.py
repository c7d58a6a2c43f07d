from veldt.shell import Shell, statements


def test_shell(spark, tmp_path):
    s = Shell(spark)
    assert s.run("SELECT 1") == "error: no database is open" and s.run("db") == "none" and "create PATH" in s.run("help") and "SELECT" in s.run("help sql")
    path = str(tmp_path / "db")
    assert s.run(f"create {path}0 UTC") == f"created {path}0" and s.run("tables") == "" and s.run(f"sample {path}") == f"created {path}, with boats and trips" and s.run("db") == path
    assert s.run("tables") == "boats\ntrips" and s.run("schema trips") == "trips: hull INT, miles REAL, port TEXT"
    assert s.run("SELECT b.name, t.miles FROM boats b JOIN trips t ON b.hull = t.hull WHERE t.port = 'bergen';") == "b.name\tt.miles\nPetrel\t61.5"
    (tmp_path / "x.sql").write_text("INSERT INTO boats VALUES (9, 'a;b', NULL);\nDELETE FROM boats WHERE hull = 7;")
    assert s.run(f"run {tmp_path / 'x.sql'}") == "1 row\n1 row" and s.run("SELECT COUNT(*) FROM trips") == "count\n1"
    assert s.run("SELECT built FROM boats WHERE name = 'a;b'") == "built\nNULL" and s.run("nonsense") == "error: parse: unsupported query form"
    assert s.run("close") == "closed" and s.run(f"open {path}") == f"opened {path}" and s.run("bye") == "closed" and s.done


def test_statements():
    assert statements("a 'x;y'; b ;; c") == ["a 'x;y'", "b", "c"]
