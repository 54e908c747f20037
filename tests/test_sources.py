import zipfile

import pytest

from samewise.sources import archives, spreadsheet
from samewise.sources.control import ControlStore


def test_workbooks_go_round(spark, tmp_path):
    p = str(tmp_path / "a.xlsx")
    wide = [f"c{i}" for i in range(30)]
    spreadsheet.write_workbook(p, {"Notes & more": (["x"], []), "Data": (["id", "name", "n"], [("1", "A <b> & ü", 2), (None, None, None), ("3", None, 4.5)]), "Wide": (wide, [[None] * 29 + ["last"]])})
    assert list(spreadsheet.sheets(p)) == ["Notes & more", "Data", "Wide"]
    got = spreadsheet.read_workbook(spark, p, "gone", ["id", "name"])
    assert [tuple(r) for r in got.collect()] == [("1", "A <b> & ü", "2"), ("3", None, "4.5")]
    assert spreadsheet.read_workbook(spark, p, "Wide").head().c29 == "last"
    with pytest.raises(ValueError, match="Notes"):
        spreadsheet.read_workbook(spark, p, "gone", ["nowhere"])
    with pytest.raises(ValueError):
        spreadsheet.read_workbook(spark, "a.csv")


def test_zip_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "PIECE", 50)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("readme.md", "x" * 5000)
        z.writestr("small.txt", "no\n")
        z.writestr("big.jsonl", "".join(f'{{"a": {i}}}\n' for i in range(40)))
    got = archives.read_lines(spark, str(tmp_path / "a.zip"), str(tmp_path / "out"))
    assert got.count() == 40 and len(list((tmp_path / "out").iterdir())) > 3
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("e.txt", "")
    assert archives.read_lines(spark, str(tmp_path / "e.zip"), str(tmp_path / "e")).count() == 0
    with pytest.raises(ValueError):
        archives.read_lines(spark, "a.rar", "x")


def test_control_store(spark, tmp_path):
    s = ControlStore(str(tmp_path / "c.db"))
    first = s.label("b", "a", True)
    second = s.label("a", "b", False)
    assert [(r.label_id, r.record_a, r.same, r.active, r.superseded_by) for r in s.snapshot(spark, "labels").collect()] == [(first, "a", True, False, second), (second, "a", False, True, None)]
    third = s.label("c", "d", True, decision_id="x")
    with pytest.raises(ValueError):
        s.withdraw(third)
    assert s.withdraw_decision("x") == 1
    s.withdraw(second)
    with pytest.raises(ValueError):
        s.withdraw(second)
    with pytest.raises(ValueError):
        s.label("a", " a ", True)
    s.override("r", "name", "X")
    s.override("r", "name", "Y")
    assert [(r.value, r.active) for r in s.snapshot(spark, "overrides").collect()] == [("X", False), ("Y", True)]
