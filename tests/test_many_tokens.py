"""Many tokens replaced by an automaton against one after the other."""

import random
import time

from pyspark.sql import functions as F

from cloakwork.functions.automaton import MANY_TOKENS, TokenAutomaton, many_tokens, scrub_many
from cloakwork.functions.text import scrub
from cloakwork.operators.reports import deid_reports

SCHEMA = "k int, text string, tokens array<string>, by string"


def in_turn(text, tokens, by):
    if text is None or tokens is None or by is None:
        return None
    for t in tokens:
        if t:
            text = text.replace(t, by)
    return text


def cases(seed, n=400):
    r = random.Random(seed)
    word = lambda least, most: "".join(r.choice("ab1_é测") for _ in range(r.randint(least, most)))
    for _ in range(n):
        tokens = [word(1, 5) for _ in range(r.randint(0, 12))]
        yield word(0, 40), sorted(tokens, key=lambda t: (-len(t), t)), r.choice(["a1", "Patient_0001", "", "测", "$1\\"])


PLANTED = [
    ("Anna Roeb", ["Anna Roe", "1b"], "Patient_0001"),  # the second token arises at the seam of the first
    ("x Anna", ["Anna", "Patient"], "Patient_0001"),
    ("aa", ["a", "a"], "ab"),
    ("text", [], "P"), ("text", None, "P"), (None, ["a"], "P"), ("", ["a"], "P"), ("a text", ["a", None, ""], "P"), ("a text", ["a"], None),
]


def test_equal_to_one_after_the_other(spark):
    given = [(k, *c) for k, c in enumerate([*PLANTED, *cases(3)])]
    df = spark.createDataFrame(given, SCHEMA)
    args = F.col("text"), F.col("tokens"), F.col("by")
    got = {x.k: (x.a, x.b) for x in df.select("k", scrub(*args).alias("a"), scrub_many(*args).alias("b")).collect()}
    for k, text, tokens, by in given:
        assert got[k] == (in_turn(text, tokens, by),) * 2, (text, tokens, by)
    assert got[0][0] == "Patient_000Patient_0001"


def test_whole_reports_either_way(spark):
    names = [f"Name{k:04d}" for k in range(MANY_TOKENS)]
    tokens = spark.createDataFrame([("p", "Patient_0001", names), ("q", "Patient_0002", ["Name0001"]), ("r", None, ["x"]), ("s", "Patient_0004", None)], "patient_key string, pseudo_id string, tokens array<string>")
    reports = spark.createDataFrame([(f"{p}{k}", p, f"<PatientName>Jane</PatientName><Report>{names[k]} and {names[1]}</Report>") for p in "pqrs" for k in range(20)] + [("n", None, names[0])], "file_id string, patient_key string, text string")
    assert many_tokens(tokens) and not many_tokens(tokens.where("patient_key = 'q'")) and not many_tokens(tokens.limit(0))
    rows = [sorted((x.file_id, x.pseudo_id, x.text_after) for x in deid_reports(reports, tokens, many=m).collect()) for m in (False, True)]
    assert rows[0] == rows[1] and len(rows[0]) == 40
    assert not any(names[1] in text or "Jane" in text for _, _, text in rows[0])


def test_time_does_not_grow_with_the_list():
    r = random.Random(5)
    tokens = [f"{r.getrandbits(40):012d}" for _ in range(20_000)]
    text = " ".join(f"w{r.getrandbits(30)}" for _ in range(3_000)) + tokens[7]
    automaton = TokenAutomaton(tokens)
    began = time.process_time()
    got = [automaton.scrub(text, "P") for _ in range(20)]
    spent = time.process_time() - began
    began = time.process_time()
    want = in_turn(text, tokens, "P")
    assert got == [want] * 20 and spent / 20 < time.process_time() - began
