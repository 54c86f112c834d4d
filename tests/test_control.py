import time

from quillspark.__main__ import main as cli
from quillspark.operators import gate
from quillspark.plans import probes


def test_probes(spark):
    def late():
        time.sleep(2)
        return "x"

    r = probes.run_probes({"good": probes.url_probe("u", lambda u, t: (204, {}, b"")), "bad": probes.url_probe("u", lambda u, t: (500, {}, b"")), "late": late}, 0.3)
    assert [x["ok"] for x in r] == [True, False, False]
    assert "1 of 3 passed" in probes.shown(r)
    assert gate.probe_tally(probes.as_table(spark, r)).first().asDict() == {"passed": 1, "failed": 2, "all_ok": False}


def test_log(tmp_path):
    log = probes.run_log(str(tmp_path / "run.log"), "t")
    log.info("hello")
    probes.close_log(log)
    assert "hello" in (tmp_path / "run.log").read_text() and not log.handlers


def test_commands(tmp_path, capsys):
    f = tmp_path / "c.yaml"
    f.write_text("timezone: UTC\noutput_dir: x\ncategories:\n  A: {query: a, max_stories: 3}\nprompts: {batch: Do it.}\nweather:\n  lakes: {fork: 'https://x/y'}\n")
    run = lambda *a: cli(["--config", str(f), "config", *a])
    assert run("validate") == 0 and "sound" in capsys.readouterr().out
    assert run("list-categories") == 0 and capsys.readouterr().out == "A\ta\t3\n"
    assert run("list-lakes") == 0 and "fork" in capsys.readouterr().out
    assert run("show-prompt", "batch") == 0 and capsys.readouterr().out == "Do it.\n"
    assert run("show-prompt", "none") == 1 and run("show") == 0
    f.write_text("categories: []\n")
    assert run("validate") == 1
    assert cli(["--config", str(tmp_path / "no.yaml"), "config", "show"]) in (0, 1)
