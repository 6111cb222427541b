"""Page furniture in four languages, and the pattern of many phrases against trying each."""

import random
import re

import duckdb

from cloakwork.llm.quality_rules import BOILERPLATE, clean_lines, phrases
from cloakwork.llm.queries import ORACLE


def test_pattern_of_phrases():
    r = random.Random(1)
    words = tuple({"".join(r.choice("ab-") for _ in range(r.randint(1, 5))) for _ in range(25)})
    one, each = re.compile(phrases(words)), [re.compile(re.escape(w)) for w in words]
    for _ in range(500):
        text = "".join(r.choice("ab-c") for _ in range(r.randint(0, 9)))
        assert bool(one.fullmatch(text)) == any(x.fullmatch(text) for x in each)


def test_furniture_of_each_language_goes(spark, tmp_path):
    clean = "\n".join(" ".join(f"wort{i * j}" for i in range(1, 25)) + "." for j in range(1, 8))
    rows = [(k, clean + "\n" + x) for k, phrase in enumerate(BOILERPLATE) for x in [f"© 2020 {phrase.upper()}!"]]
    rows += [(1000, clean + "\nx" + "all rights reservedy"), (1001, clean + "\nétous droits réservésé")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = {x.doc_id: x.clean_text for x in clean_lines(df).collect()}
    assert all(by[k] == clean for k in range(len(BOILERPLATE))) and by[1000] == rows[-2][1] and by[1001] == clean
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert all(con.execute(f"select kept from ({ORACLE['op5_quality_rules']})").fetchnumpy()["kept"])
    sql = ORACLE["op5_quality_rules"].replace("SELECT doc_id, n_words, word_chars", "SELECT doc_id, lost, n_words, word_chars")
    lost = dict(con.execute(f"select doc_id, lost from ({sql})").fetchall())
    assert {k: v > 0 for k, v in lost.items()} == {k: len(by[k]) < len(t) for k, t in rows}
