import pytest

from featlake.functions import workflow as W


def test_substitute():
    assert W.substitute({"a": ["${x}/y", 3]}, {"x": "r"}) == {"a": ["r/y", 3]}
    with pytest.raises(KeyError):
        W.substitute("${z}", {})


def test_redaction():
    assert W.redact_command(["run", "--api-key", "abc", "--token=t", "--width", "5"]) == ["run", "--api-key", "***", "--token=***", "--width", "5"]


def test_grid_of_468():
    axes = {"kind": ["flat", "tree"], "width": ["512", "4096", "32768"], "seed": [str(s) for s in range(78)]}
    got = W.expand(["fit", "${kind}", "${width}", "${seed}"], axes)
    assert len(got) == 468 and len({tuple(c) for c in got}) == 468 and got[0] == ["fit", "flat", "512", "0"]


def test_remap_by_longest_prefix():
    t = {"/a": "/x", "/a/b": "/y"}
    assert [W.remap(p, t) for p in ("/a/b/c", "/a/bc", "/d")] == ["/y/c", "/x/bc", "/d"]


def test_plan_and_balance(tmp_path):
    assert W.plan([["a", "--password", "p"]], [str(tmp_path), "/no/such"]) == {"commands": [["a", "--password", "***"]], "missing": ["/no/such"]}
    assert W.balanced({"a": 5, "b": 4, "c": 3, "d": 3}, 2) == [["a", "d"], ["b", "c"]]
