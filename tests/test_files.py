"""Manifests with many cases, and what errors say."""

import json

import pytest

from linkscape.sources import files as S


def written(folder, cases, columns=None):
    """A case is its vertices as lines below a head, and its arcs."""
    folder.mkdir()
    (folder / "options.csv").write_text("id,cost\no,1\np,2\n")
    manifest = {"options": {"csv_file": "options.csv"}, "cases": {}}
    for case, (vertices, arcs) in cases.items():
        (folder / f"{case}_v.csv").write_text(vertices)
        (folder / f"{case}_a.csv").write_text(arcs)
        manifest["cases"][case] = {"vertices": {"csv_file": f"{case}_v.csv", **({"csv_columns": columns[case]} if columns else {})}, "arcs": {"csv_file": f"{case}_a.csv"}}
    (folder / "m.json").write_text(json.dumps(manifest))
    return f"file://{folder}/m.json"


V, A = "id,source_quality,target_quality\n", "id,from,to,probability\n"


def test_many_cases_are_one_scan_a_table(spark, tmp_path):
    cases = {f"c {k}": (V + f"a,{k},1\nb,0,2\n", A + "ab,a,b,0.5\n") for k in range(60)}
    cases["turned"] = ("target_quality,id,source_quality\n7,a,8\n1,b,0\n", A + "ab,a,b,0.25\n")
    land = S.read_landscape(spark, written(tmp_path / "many cases", cases))
    assert land.vertices._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2  # two heads
    assert land.arcs._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1
    found = {(r.case_id, r.vertex_id): (r.source_quality, r.target_quality) for r in land.vertices.collect()}
    want = {(f"c {k}", v): q for k in range(60) for v, q in (("a", (float(k), 1.0)), ("b", (0.0, 2.0)))} | {("turned", "a"): (8.0, 7.0), ("turned", "b"): (0.0, 1.0)}
    assert found == want and land.vertices.columns == ["case_id", "vertex_id", "source_quality", "target_quality"]
    assert land.arcs.count() == 61 and land.vertex_improvements.count() == 0


def test_a_file_of_several_cases_and_own_names_of_columns(spark, tmp_path):
    manifest = written(tmp_path / "l", {"x": ("name,s\na,1\n", A), "y": (V + "b,1,2\n", A)}, {"x": {"id": "name", "source_quality": "s", "target_quality": "s"}, "y": {}})
    data = json.loads((tmp_path / "l" / "m.json").read_text())
    data["cases"]["z"] = data["cases"]["y"]
    data["cases"]["w"] = {"vertices": [{"id": "q", "source_quality": 3, "target_quality": 4}], "arcs": []}
    (tmp_path / "l" / "m.json").write_text(json.dumps(data))
    rows = sorted(map(tuple, S.read_landscape(spark, manifest).vertices.collect()))
    assert rows == [("w", "q", 3.0, 4.0), ("x", "a", 1.0, 1.0), ("y", "b", 1.0, 2.0), ("z", "b", 1.0, 2.0)]


def test_errors_name_file_and_row(spark, tmp_path):
    many = "".join(f"v{k},1,1\n" for k in range(300))
    bad = {"x": (V + many + "late,-1,1\n", A), "y": (V + "a,1,1\na,2,2\n", A + "fine,a,a,0.5\noff,a,zz,0.5\n")}
    manifest = written(tmp_path / "l", bad)
    with pytest.raises(ValueError) as e:
        S.read_landscape(spark, manifest)
    said = set(str(e.value).replace(f"file://{tmp_path}/l/", "").replace(f"file:{tmp_path}/l/", "").split("; "))
    assert said == {"vertices late: source_quality >= 0 (x_v.csv, row 301)", "vertices a: duplicate (y_v.csv, row 2)", "arcs zz: unknown vertex (y_a.csv, row 2)"}
