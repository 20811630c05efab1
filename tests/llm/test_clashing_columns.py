"""Every operator and stage on a table whose extra columns have the names that the operators use inside."""

import numpy as np
import pytest

from lakesearch.llm import chat, decontaminate, html_text, licences, mixing, near_copies, quality_crf, quality_rules, simhash, substring_dedup, toxicity
from lakesearch.llm.store import written

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
NAMES = "copies part cut cut_slice extra size source_size target taken block bucket keys bits step fp low high root node label key t n parity bands row of lines units unit digest license words blank hash place width item_id removed_spans n_words n_removed toxicity score quality u q id s slice gone x others none u_ mix_source n_lines n_distinct page_id".split()


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "one two", " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)) + " end", "line\n" * 30, "x" * 30_000] + [f"text number {i} of the corpus " + " ".join(f"a{i}b{k}" for k in range(30)) for i in range(20)]
    rows = [(i, t, "en", f"s{i % 3}", 0, *(f"{name}{i}" for name in NAMES)) for i, t in enumerate(texts)]
    rows += [rows[3], (None, *rows[3][1:])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)).cache()


OPERATORS = {
    "substring_dedup": lambda d: substring_dedup.drop_repeats(d),
    "quality_rules": lambda d: quality_rules.judged(m := quality_rules.measure(d), quality_rules.label_model(m)),
    "mixing": lambda d: mixing.mix(d),
    "licences": lambda d: licences.scan(d),
    "simhash": lambda d: simhash.keep_one(d),
    "near_copies": lambda d: near_copies.keep_one(d),
    "decontaminate": lambda d: decontaminate.without_matches(d, d.sparkSession.read.parquet(f"{SF}/benchmark.parquet")),
    "quality_crf": lambda d: quality_crf.with_quality(d, quality_crf.fit(["a b"], np.array([1]))),
    "html_text": lambda d: html_text.with_main_text(d.withColumnRenamed("text", "html")),
    "toxicity": lambda d: toxicity.with_toxicity(d, toxicity.fit(["a b"], np.array([1]))),
    "chat": lambda d: chat.read_back(chat.format_chats(d.selectExpr("doc_id as conv_id", "doc_id as seq", "doc_id as turn", "lang as role", "source as kind", "text", *NAMES))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(docs, name):
    out = OPERATORS[name](docs)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert rows and OPERATORS[name](docs.limit(0)).count() == 0
    # columns that the operator doesn't write keep their values
    if name not in ("licences", "chat"):
        assert all(r.lang == "en" and r.hash.startswith("hash") and r.others.startswith("others") and r.bucket.startswith("bucket") for r in rows)


def test_stages(spark, docs):
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, out, SF), name)
        assert out.columns == docs.columns
        assert all(r[n] is not None and r[n].startswith(n) for r in out.collect() for n in NAMES)
    last = corpus_pipeline.STAGES[-1][1](spark, out, SF)
    rows = written(last, "mixed").collect()
    assert rows and len({c.lower() for c in last.columns}) == len(last.columns)
    assert all(r.taken == r.copies * r.size and r.cut.startswith("cut") and r.extra.startswith("extra") for r in rows)
    assert [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "copies")] == [c for c in last.columns if c not in ("size", "source_size", "target", "taken", "copies")]
