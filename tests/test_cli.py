import json

from graphloom import cli


def test_tables():
    assert cli.render(["a"], [], False) == "No results."
    assert cli.render(["a", "b"], [["1", "long"]], False) == "+---+------+\n| a | b    |\n+---+------+\n| 1 | long |\n+---+------+"
    assert cli.render(["a"], [["1"]], True) == "\x1b[1;36ma\x1b[0m\n1"
    assert cli.display_root("/x/y/.graph") == "/x/y" and cli.display_root("/x/other") is None


def test_index_query_export(spark, tmp_path, capsys):
    root, store = tmp_path / "r", str(tmp_path / "s")
    root.mkdir()
    (root / "a.py").write_text("import os\n\ndef run():\n    return go()\n\ndef go():\n    return 1\n")
    assert cli.main(["index", str(root), "--store", store]) == 0
    capsys.readouterr()
    for query, names, wanted in [("symbols", ["run"], "a.run"), ("callers", ["go"], "a.run"), ("callees", ["run"], "a.go"), ("packages", [], "os"), ("deps", ["a.py"], "os"), ("impact", ["a.py"], "a.py")]:
        assert cli.main(["query", query, *names, "--store", store]) == 0
        assert wanted in capsys.readouterr().out
    cli.main(["query", "callers", "go", "--store", store, "--format", "json"])
    found = json.loads(capsys.readouterr().out)
    assert found["query"] == "callers" and found["results"][0]["location"] == "a.py:3:1"
    assert list(found["results"][0]) == cli.NODE_RECORD and found["results"][0]["span"]["start"] == {"line": 3, "column": 1}
    cli.main(["query", "symbols", "run", "--store", store, "--format", "json"])
    assert list(json.loads(capsys.readouterr().out)["results"][0]) == cli.SYMBOL_RECORD
    cli.main(["query", "callers", "go", "--store", store, "--pretty"])
    table = capsys.readouterr().out.splitlines()
    assert table[1].split("|")[1].strip() == "name" and "a.run" in table[3] and len({len(x) for x in table}) == 1
    cli.main(["export", "--store", store, "--format", "symbols"])
    assert all(json.loads(x)["kind"] == "symbol" for x in capsys.readouterr().out.splitlines())
    cli.main(["export", "--store", store, "--output", str(tmp_path / "out")])
    assert spark.read.text(str(tmp_path / "out")).count() > 3
