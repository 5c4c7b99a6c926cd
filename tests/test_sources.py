import pytest

from gatewarden.plans.engine import Engine, error_label, reload_entry
from gatewarden.sources import files
from gatewarden.sources.config import ConfigError, config, config_from, pool

POLICY = """
version: 1
metadata: {name: demo}
rules:
  - {id: A, category: c, pattern: Jailbreak Now, action: block}
  - {id: B, category: pii, pattern: '/[0-9]{9}/', action: redact, placeholder: NINE, compliance: [GDPR]}
"""


def test_keyword_dictionary():
    rules = files.keyword_rules("# c\n\ndeveloper mode\t0\t8.0\ncasino\t2\n/a+b/\t1\n")
    assert [(r.pattern, r.tier, r.regex) for r in rules] == [("developer mode", "block", False), ("casino", "flag", False), ("a+b", "alert", True)]
    for bad in ("x", "x\ty", "x\t3", "/(/\t0"):
        with pytest.raises(files.RuleFileError, match=":1:"):
            files.keyword_rules(bad)


def test_entity_dictionary():
    rules = files.entity_rules("/\\bSEC-\\d{6}\\b/\tinternal_ticket\n/a/b/\t0\nplain\tX\n/(/\tBAD")
    assert [(r.entity, r.pattern) for r in rules] == [("INTERNAL_TICKET", r"\bSEC-\d{6}\b"), ("PII_2", "a/b")]


def test_policy():
    found = files.policy(POLICY)
    assert [r.pattern for r in found.keywords()] == ["Jailbreak Now"] and found.entities()[0].entity == "NINE" and found.rules[0].severity == "medium"
    for bad in ("version: 99\nrules: []", POLICY.replace("id: B", "id: A"), POLICY.replace(", placeholder: NINE", ""), "[1"):
        with pytest.raises(files.RuleFileError):
            files.policy(bad)


def test_validation_by_path():
    assert files.validated("p.yaml", POLICY) is None and files.validated("d.txt", "x") and files.validated("pii.txt", "/(/\tA")
    assert files.validated("x.json", "{}") == "unknown file type for `x.json`" and files.validated("c.toml", "a = ")


BACKENDS = '[backends.a]\nprovider = "p"\nendpoint = "e"\n[backends.b]\nprovider = "p"\nendpoint = "e"\n'


def test_config_and_pool():
    assert config("").input.enabled is False and config("[input]\n").input.enabled is True
    assert config_from(None, {}).backend.provider == "ollama"
    good = config(BACKENDS + '[routing]\ndefault = "a"\n[[routing.rules]]\nmodel = "x*"\nbackend = "b"\nfallback = ["a"]\n')
    assert pool(good).default == "a"
    for bad in (BACKENDS, BACKENDS + '[routing]\ndefault = "z"\n', BACKENDS + '[routing]\ndefault = "a"\n[[routing.rules]]\nmodel = "x"\nbackend = "b"\nfallback = ["b"]\n', ""):
        with pytest.raises(ConfigError):
            pool(config(bad))
    with pytest.raises(ConfigError):
        config("[input.keyword]\nengine = 'x'\n")


def test_engine_takes_policy_before_dictionaries(spark):
    text = '[backend]\nprovider = "p"\nendpoint = "e"\n[policies]\nbundle_path = "p.yaml"\n[input.keyword]\ndict_paths = ["d.txt"]\ninline_block = ["one"]\ninline_alert = []\ninline_flag = []\n'
    engine = Engine.build(config(text), {"p.yaml": POLICY, "d.txt": "two\t0"}.__getitem__)
    assert [r.pattern for r in engine.keywords.rules] == ["one", "Jailbreak Now", "two"]
    assert error_label(FileNotFoundError()) == "file_not_found" and reload_entry(ValueError(), "r", "t", 1)["error"] == "build_failed"


def test_reports_are_written(spark, tmp_path):
    import json

    report = spark.createDataFrame([("EMAIL", 3, 1.0), ("TOTAL", 3, 0.5)], "entity string, tp long, f1 double")
    files.write_report(report, f"file://{tmp_path}/report")
    assert {tuple(r) for r in spark.read.json(f"file://{tmp_path}/report").select("entity", "tp", "f1").collect()} == {("EMAIL", 3, 1.0), ("TOTAL", 3, 0.5)}
    assert json.loads(files.report_json([r.asDict() for r in report.collect()]))[1] == {"entity": "TOTAL", "tp": 3, "f1": 0.5}
