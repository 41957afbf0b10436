"""Language identification: the parse against brute force, accuracy on held-out rows, awkward inputs."""

import random
import zlib

import pytest

from tidewire.llm import langid
from tidewire.llm.langid import CrossParser, identify


def brute(parser, text, sample):
    spell = lambda t: "".join(chr(65 + x) for x in parser.symbols([t.lower()])[0])
    text, sample, n, at = spell(text), spell(sample), 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        at, n = at + k, n + 1
    return n


@pytest.mark.parametrize("span", [1024, 100, 7, 1])
def test_phrases(span, monkeypatch):
    monkeypatch.setattr(langid, "SPAN", span)
    r = random.Random(3)
    samples = {k: " ".join("".join(r.choice(a) for _ in range(r.randint(1, 6))) for _ in range(200)) for k, a in (("x", "abcde"), ("y", "cdeéß"))}
    parser = CrossParser(samples)
    texts = ["", "a", "Ж", "abc Жé", "!!", samples["x"][:500], samples["x"][3:] + "!" + samples["x"], "ab" * 700, *(" ".join("".join(r.choice("abcdeéßЖ.1") for _ in range(5)) for _ in range(r.randint(1, 400))) for _ in range(20))]
    got, _ = parser.phrases(texts)
    assert got.tolist() == [[brute(parser, t, samples[k]) for k in parser.languages] for t in texts]


def test_identify(spark):
    r = random.Random(1)
    kinds = {"aa": ["the", "and", "of", "wind"], "bb": ["und", "der", "die", "straße"]}
    rows = [(i, " ".join(r.choice(kinds[k]) for _ in range(20)), k) for i in range(300) for k in [r.choice(["aa", "bb"])]]
    odd = [(1000, None, "aa"), (1001, "", None), (1002, "12 !", "bb"), (1003, "the wind " * 20_000, None), (1004, rows[0][1], None), (1004, rows[0][1], None), (None, "the", "aa")]
    docs = spark.createDataFrame([(*x, 1.0, 2) for x in rows + odd], "doc_id long, text string, lang string, score double, n int")
    got = identify(docs).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows) + len(odd) - 1
    assert all(by[i].lang_pred == k and by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= by[i].score <= 1 for i, _, k in rows)
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "aa", rows[0][2]]
    assert {(x.row, x.doc_id) for x in identify(docs.withColumn("row", docs.n + 5), row_col="row").collect()} == {(7, x.doc_id) for x in got}
    # A language with long texts alone is learnt from their beginnings.
    long = spark.createDataFrame([(i, "lorem ipsum dolor " * 5000, "cc") for i in range(20)], "doc_id long, text string, lang string")
    assert {x.lang_pred for x in identify(long.unionByName(docs.select("doc_id", "text", "lang"))).where("doc_id < 20").collect()} >= {"cc"}
    nothing = identify(docs.where("doc_id > 1004"))
    assert nothing.count() == 0
    assert {x.lang_pred for x in identify(docs.withColumn("lang", docs.lang.substr(9, 1))).collect()} <= {"und", ""}
