"""The command line on a small index."""

import json

from searchlake.cli import main


def test_commands(spark, tmp_path, capsys):
    path, lines = str(tmp_path / "ix"), tmp_path / "in.jsonl"
    lines.write_text("\n".join(json.dumps({"k": f"d{i}", "t": f"word{i} shared"}) for i in range(3)))
    assert main(["create", path], spark) == 0
    assert main(["bulk", path, str(lines), "--id", "k"], spark) == 0
    capsys.readouterr()
    main(["query", path, "t:word1"], spark)
    got = json.loads(capsys.readouterr().out)
    assert got["total"] == 1 and got["hits"][0]["id"] == "d1"
    for args, want in ((["count", path], "3"), (["fields", path], "k\nt"), (["dictionary", path, "t", "--prefix", "sh"], "shared 3"), (["versions", path], "1 2"), (["check", path], "postings without a document: 0; wrong counts: 0")):
        assert main(args, spark) == 0
        assert capsys.readouterr().out.strip() == want
    main(["bulk", path, str(lines), "--id", "k"], spark)
    capsys.readouterr()
    for args, want in ((["dump-fields", path, "--id", "d1"], "d1 _all d1 shared word1\nd1 k d1\nd1 t shared word1"), (["deleted", path, "1"], "d0\nd1\nd2"), (["deleted", path, "2"], ""), (["check", path], "postings without a document: 0; wrong counts: 0")):
        assert main(args, spark) == 0
        assert capsys.readouterr().out.strip() == want, args
    main(["segments", path], spark)
    assert [json.loads(x)["n"] for x in capsys.readouterr().out.splitlines()] == [1, 2]
    main(["segment", path, "2"], spark)
    assert json.loads(capsys.readouterr().out)["docs"] == 3
    main(["terms", path, "1", "--field", "t"], spark)
    assert capsys.readouterr().out.startswith("t shared 3")
    main(["registry"], spark)
    assert "standard" in json.loads(capsys.readouterr().out)["analyzers"]
