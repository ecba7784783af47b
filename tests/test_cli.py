import sys

import pytest

from glossa import cli, errors


class Terminal:
    def __init__(self, tty=True):
        self.tty = tty

    def isatty(self):
        return self.tty


@pytest.fixture
def answers(monkeypatch):
    lines = []

    def read():
        line = lines.pop(0)
        if line == "^C":
            raise KeyboardInterrupt
        return line

    monkeypatch.setattr(sys, "stdin", Terminal())
    run = cli.run_session
    monkeypatch.setattr(cli, "run_session", lambda text: run(text, read=read))
    return lines


@pytest.mark.parametrize(("args", "message"), [(["x", "-f", "y"], "mutually exclusive"), ([], "supply TEXT or -f"), (["x", "--in-place"], "requires"), (["x"], "interactive terminal")])
def test_usage(monkeypatch, capsys, args, message):
    monkeypatch.setattr(sys, "stdin", Terminal(tty=False))
    assert cli.main(args) == 2
    assert message in capsys.readouterr().err


def test_outputs_exclude_each_other():
    with pytest.raises(SystemExit) as e:
        cli.main(["-f", "a", "-o", "b", "--in-place"])
    assert e.value.code == 2


def test_failures_name_the_file(monkeypatch, capsys, tmp_path):
    monkeypatch.setattr(sys, "stdin", Terminal())
    (tmp_path / "bad").write_bytes(b"caf\xe9")
    for name, message in (("none", "not found"), (".", "is a directory"), ("bad", "cannot decode")):
        assert cli.main(["-f", str(tmp_path / name)]) == 1
        err = capsys.readouterr().err
        assert message in err and str(tmp_path) in err and "Traceback" not in err


def test_lexicon_errors(monkeypatch, capsys):
    monkeypatch.setattr(sys, "stdin", Terminal())
    monkeypatch.setattr(cli, "run_session", lambda text: (_ for _ in ()).throw(errors.EmptyAlternativesError("bad")))
    assert cli.main(["x"]) == 1 and "bad" in capsys.readouterr().err


def test_session_and_outputs(spark, answers, capsys, tmp_path, monkeypatch):
    monkeypatch.setenv("NO_COLOR", "")
    answers += ["9", "2", ""]
    assert cli.main(["You use it. I use it"]) == 0
    out = capsys.readouterr()
    assert out.out == "You employ it. I employ it"
    assert "Invalid: enter a number from 0 to 4." in out.err and "2) employ [default]" in out.err and "\x1b" not in out.err
    doc = tmp_path / "doc.md"
    doc.write_text("use and use")
    answers[:] = ["1", "^C"]
    assert cli.main(["-f", str(doc), "--in-place"]) == 130
    assert doc.read_text() == "utilize and use"
    answers[:] = ["0"]
    assert cli.main(["use", "-o", str(tmp_path / "out")]) == 0 and (tmp_path / "out").read_text() == "use"
