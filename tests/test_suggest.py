import json

import pytest

from leafmill import cli
from leafmill.functions.suggest import edits, hint, nearest


@pytest.mark.parametrize("a, b, n", [("", "", 0), ("", "abc", 3), ("abc", "", 3), ("kitten", "sitting", 3), ("flaw", "lawn", 2), ("same", "same", 0)])
def test_edits(a, b, n):
    assert edits(a, b) == n


def test_nearest_names():
    names = ["plan", "result", "error", "extraction_result", "extraction_report"]
    assert nearest("plam", names) == ["plan"]
    assert nearest("RESULT", names) == ["result", "extraction_result"]
    assert nearest("extraction", names) == ["extraction_report", "extraction_result"]
    assert nearest("zzzzzzzz", names) == [] and hint("zzzzzzzz", names) == ""
    assert hint("plam", names) == " Did you mean `plan`?"


def test_catalog_and_schema_as_json():
    catalog = json.loads(cli.run(["catalog", "--output", "json"]))
    assert catalog["schema_name"] == "catalog_report" and "select.extract" in [o["operation_id"] for o in catalog["operations"]]
    schema = json.loads(cli.run(["schema", "--name", "plan", "--output", "json"]))
    assert schema["schemas"] == [{"schema_name": "plan", "schema_version": 8, "owner": "interop"}]


def test_unknown_names_are_told_with_suggestions():
    with pytest.raises(cli.Failure, match="`select.extract`"):
        cli.run(["catalog", "--operation", "select.extrac"])
    with pytest.raises(cli.Failure, match="Did you mean `plan`"):
        cli.run(["schema", "--name", "plam"])
    with pytest.raises(cli.Failure, match="Versions: 8"):
        cli.run(["schema", "--name", "plan", "--schema-version", "1"])
