"""Queries against their SQL on texts where engines differ in what a word, a blank or a small letter is."""

import pandas as pd
import pytest

from candor.plans import audit_queries

duckdb = pytest.importorskip("duckdb")


def same_as_sql(spark, folder, name: str, **tables: pd.DataFrame) -> pd.DataFrame:
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.to_parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want = con.execute(audit_queries.ORACLES[name]).df()
    got = audit_queries.QUERIES[name](spark, str(folder)).toPandas()
    assert list(got.columns) == list(want.columns)
    key = lambda x: sorted(tuple("" if pd.isna(v) else str(float(v)) if isinstance(v, float) else str(v) for v in r) for r in x.itertuples(index=False))
    assert key(got) == key(want)
    return want


def documents(texts) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": range(2, 3 * len(texts) + 2, 3), "text": texts, "lang": "en", "source": "s", "n_chars": [len(t or "") for t in texts]})


def test_passages_stand_beside_accents(spark, tmp_path):
    passage = "one two three four five six seven eight nine bar"
    docs = documents([f"{passage}é x", f"é{passage}", passage.replace("bar", "bär"), f"{passage}s", passage.replace("six", "sİx").upper(), passage.replace("six", "SİX"), None, ""])
    found = same_as_sql(spark, tmp_path, "q_phrase_contamination", documents=docs, benchmark=pd.DataFrame({"item_id": [1, 2, 3], "text": [passage, "é", None]}))
    assert set(found.doc_id) == {2, 5, 14, 17}


ENDS = ["elleêan", "ê an", "wſas", "was", "waſ", "ein", "éto", "xſo", "a ſo", "oK", "ın", "of\xa0", "of\t", "of\x0b", "of\r", "of  ", "end.\r", "end.\x85", "end. ", "end.\xa0", "‘a’\xa0b", "\xa0‘a", "‘a’\x0bb", "''", "('", "(a)", "«", "am"]


@pytest.mark.parametrize("name", ["q_truncation_audit", "q_truncation_sensitivity"])
def test_cut_answers(spark, tmp_path, name):
    texts = [f"Words of this {e}" for e in ENDS] + [f" {e} of" for e in ENDS] + [f"Words and more words of this\n{e}" for e in ENDS] + ["a\x0bb\x0bc", "\xa0'tis it now then so well"]
    texts += [None] if name == "q_truncation_audit" else []
    same_as_sql(spark, tmp_path, name, documents=documents(texts * 2))
