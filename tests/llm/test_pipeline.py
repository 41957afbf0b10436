"""The pipeline's stages, one after another, against brute force over the rows that each was given."""

import random

import corpus_pipeline
from tests.llm.test_near_dedup import brute
from tidewire.llm import mixing
from tidewire.llm.common import staged


def test_stages(spark, tmp_path):
    r = random.Random(11)
    words = ["".join(r.choice("aeioudnrst") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows, marks = [], []
    for i in range(120):
        text = " ".join(r.choice(words) for _ in range(r.randint(8, 90)))
        rows.append((i, text, "en", "s", len(text)))
        marks.append((i, int(i % 5 > 0), int(i % 7 == 0)))
    rows += [(200 + i, rows[i][1].replace(" ", "  "), "en", "s", 1) for i in range(10)]  # exact copies
    rows += [(300 + i, rows[i + 20][1] + " tail", "en", "s", 1) for i in range(10)]  # near copies, if long
    rows += [(400, None, "en", "s", 0), (401, "12 34 !!", None, None, 8), (402, "", "en", "s", 0)]
    rows += [(None, rows[3][1], "en", "s", 1), (5, rows[5][1], "en", "t", 1), (7, rows[7][1], "en", "s", len(rows[7][1]))]  # no id, ids again
    rows = [(*x, i, "clash") for i, x in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, tokens int, row string"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    (_, language), (_, exact), (_, near), (_, mixture), (_, pack) = corpus_pipeline.STAGES

    def ids(df):
        assert df.columns == docs.columns
        return sorted(x.doc_id for x in df.collect())

    spoken = staged(language(spark, docs, str(tmp_path)), "t1")
    assert ids(spoken) == sorted(x[0] for x in rows if x[0] is not None and x[1] and any(map(str.isalpha, x[1])))
    single = staged(exact(spark, spoken, str(tmp_path)), "t2")
    first = {}
    for x in sorted(spoken.collect()):
        first.setdefault(" ".join(x.text.split()), x.doc_id)
    assert ids(single) == sorted(first.values())
    apart = staged(near(spark, single, str(tmp_path)), "t3")
    assert ids(apart) == sorted(i for i, _, _, kept in brute([(x.doc_id, x.text) for x in single.collect()], 5, 80, 100) if kept)
    mixed = staged(mixture(spark, apart, str(tmp_path)), "t4")
    rated = mixing.mix_by_labels(apart, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()
    assert ids(mixed) == sorted(x.doc_id for x in rated for _ in range(x.copies))
    pieces = pack(spark, mixed, str(tmp_path)).collect()
    assert sorted({p.doc_id for p in pieces}) == sorted(set(ids(mixed)))
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    empty = docs.limit(0)
    assert all(stage(spark, empty, str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)
    # A text between two languages is in neither.
    two = [(i, f"{'the wind and sea ' * 30 if i % 2 else 'der wald und see ' * 30}", "en" if i % 2 else "de", "s", 1, 1, "c") for i in range(60)]
    odd = spark.createDataFrame([*two, (100, "the wald and see der wind und sea ", None, "s", 1, 1, "c"), (101, "zzz qqq xxx", None, "s", 1, 1, "c")], schema)
    assert {x.doc_id for x in odd.join(language(spark, odd, str(tmp_path)), "doc_id", "left_anti").collect()} <= {100, 101}
    assert {p.doc_id for p in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {p.doc_id for p in pieces}
