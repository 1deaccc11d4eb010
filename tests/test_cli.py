import json

import pytest

from crosswise import cli


def write(path, data):
    path.write_text(json.dumps(data))
    return str(path)


def test_labels():
    assert cli.labelled(["a=x", "b=y=z"]) == {"a": "x", "b": "y=z"}
    for bad in (["a=x"], ["a=x", "a=y"], ["a=x", "b"]):
        with pytest.raises(SystemExit):
            cli.labelled(bad)


def test_lines(spark, tmp_path):
    section = lambda label, kind, a, b: {"section_index": a, "section_label": label, "section_type": kind, "start_line": a, "end_line": b}
    (tmp_path / "doc.md").write_text("x\n" * 9)
    runs = {"A": write(tmp_path / "a.json", [{"sections": [section("Intro", "t", 1, 6), section("End", "u", 7, 10)]}]), "B": write(tmp_path / "b.json", {"sections": [section("Intro", "t", 1, 8)]})}
    out = cli.compare_lines(spark, runs, str(tmp_path / "doc.md"), "prepass", None, 0.75)
    assert "10 lines" in out and "| B | 6 | 0.6 | 0.6 |" in out and "| 7 | 10 |" in out


def test_compounds(spark, tmp_path):
    a = [{"identifier": "DIPEA", "aliases": ["Hünig base"]}, {"identifier": "Compound X"}, {"identifier": "Intermediate 1"}]
    b = [{"identifier": "hünig base"}, {"identifier": "intermediate 1."}, {"identifier": "Compound Y"}, {"identifier": "water"}]
    runs = {"claude": write(tmp_path / "a.json", a), "other": write(tmp_path / "b.json", {"compounds": b})}
    out = cli.compare_compounds(spark, runs, str(tmp_path / "o.json"))
    assert "| other | 2 | 1 | 2 | 0.6667 | 0.5 |" in out
    assert json.loads((tmp_path / "o.json").read_text())["summary"] == {"first": 3, "second": 4, "common": 2, "first_only": 1, "second_only": 2}


def test_reactions(spark, tmp_path):
    rx = lambda name, **more: {"product_name": name, "section_label": "S", "step_index": 0, **more}
    runs = {"A": write(tmp_path / "a.json", [rx("P 1"), rx("gone", non_synthetic=True)]), "B": write(tmp_path / "b.json", {"reactions": [rx("p  1", compounds=[{"identifier": "x", "smiles": "CC", "role": "product", "is_product": True}])]})}
    steps = [{"step_index": 0, "step_label": "s", "section_label": "S", "section_type": "t", "start_line": 1, "end_line": 4}]
    r1 = {k: write(tmp_path / f"{k}.r1.json", steps) for k in runs}
    out = cli.sweep_reactions(spark, runs, "tau_provenance", [0.5], r1)
    assert "| 0.5 | 1 | 1 | 0 | 1 | 1 | 2 | 1 | 0 | 0 | — |" in out
