import json

import pytest
from tidemark.plans import steps


def test_done_once_and_again_when_inputs_change(tmp_path):
    s, out, calls = steps.Steps(tmp_path / "s"), tmp_path / "o.csv", []

    def work():
        calls.append(1)
        out.write_text(f"x{len(calls)}")

    a, b = steps.fingerprint(x=1), steps.fingerprint(x=2)
    assert s.run("one", a, [str(out)], work) and not s.run("one", a, [str(out)], work)
    assert s.run("one", b, [str(out)], work) and len(calls) == 2
    out.write_text("changed")  # an output that isn't as written is made again
    assert s.run("one", b, [str(out)], work) and len(calls) == 3


def test_valid_outputs_without_a_record_are_adopted(tmp_path):
    s, out = steps.Steps(tmp_path / "s"), tmp_path / "o"
    out.write_text("there")
    assert not s.run("one", "f", [str(out)], lambda: pytest.fail("not needed"))
    assert s.is_done("one", "f")


def test_invalid_outputs_fail_and_are_tried_again(tmp_path):
    s, out = steps.Steps(tmp_path / "s"), tmp_path / "o"
    with pytest.raises(ValueError):
        s.run("one", "f", [str(out)], lambda: None)
    assert s.record("one")["state"] == "failed"
    assert s.run("one", "f", [str(out)], lambda: out.write_text("x"))


def test_one_holder_and_whole_files(tmp_path):
    s = steps.Steps(tmp_path / "s")
    with s.held(), pytest.raises(RuntimeError), steps.Steps(tmp_path / "s").held():
        pass
    steps.write_json(tmp_path / "a.json", {"k": 1})
    assert json.loads((tmp_path / "a.json").read_text()) == {"k": 1} and len(list(tmp_path.glob(".a*"))) == 0
    (tmp_path / "s" / "one.json").write_text("{half")
    assert s.record("one") is None
