from __future__ import annotations

import json

from graphloom.__main__ import main, parser, result


def rows(spark, *argv):
    return [json.loads(x) for x in result(spark, parser().parse_args(list(argv))).toJSON().collect()]


def test_commands(spark, data, tmp_path, capsys):
    assert main(["queries"]) == 0 and "resolution_counts" in capsys.readouterr().out
    assert main(["run", "nothing", "--data", data]) == 2
    assert rows(spark, "run", "coverage", "--data", data)[0]["complete"] is False
    assert [r["rank"] for r in rows(spark, "search", "ring", "--data", data, "--limit", "3")] == [1, 2, 3]
    assert rows(spark, "suggest", "Assets/", "--data", data)
    assert len(rows(spark, "references", "object:nation:2", "--data", data, "--limit", "2")) == 2
    (tmp_path / "a.mat").write_text("--- !u!21 &5\nMaterial:\n  m_Name: red\n")
    assert rows(spark, "inspect", "scenes", str(tmp_path))[0]["name"] == "red"


def test_plans_and_capabilities(tmp_path, capsys):
    (tmp_path / "p.json").write_text('{"version": 3, "operations": []}')
    (tmp_path / "bad.yaml").write_text("version: 2\n")
    assert main(["validate", str(tmp_path / "p.json")]) == 0 and main(["validate", str(tmp_path / "bad.yaml")]) == 1 and main(["capabilities"]) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert out[0]["valid"] and not out[1]["valid"] and len(out[2]["errors"]) == 13


def test_export_of_scenes(spark, tmp_path):
    from graphloom import __main__ as cli
    from graphloom.sources import scenes

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.prefab").write_text("%YAML 1.1\n--- !u!1 &5\nGameObject:\n  m_Name: Player\n  n: [1, 2]\n--- !u!4 &6\nTransform:\n  x: 1\n")
    args = cli.parser().parse_args(["export", str(tmp_path / "in"), f"file://{tmp_path}/out", "--class-id", "1"])
    (row,) = cli.result(spark, args).collect()
    assert row.status == "Written" and scenes.value_of((tmp_path / "out" / row.path).read_text().split("\n")) == {"GameObject": {"m_Name": "Player", "n": [1, 2]}}
