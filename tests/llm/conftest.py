import os
import random

import pytest

TEXT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark, folder):
    """The small documents table plus hard cases: nulls, empty and very long texts, ties, repeated rows, shared passages, near copies."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(120), prose(6000)
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(os.path.join(folder, "documents.parquet")).collect()]
    near = prose(300).split()
    for k in range(12):
        own = list(near)
        own[20 * k + 3] = word()
        rows.append((1000 + k, " ".join(own), "src0"))
    rows += [(1100 + k, f"{prose(k % 5)} {passage} {prose(k % 7)}", "src1") for k in range(20)]
    rows += [(1200, None, "src2"), (1201, "", None), (1202, " \n\t ", None), (1203, "one", "src3"), (1204, "one", "src3"), (1205, "a b c", ""), (1206, "A B C", "")]
    rows += [(1300, long, "src0"), (1301, "x " + long, "src0"), (1302, "ab" * 3000, "src4"), (1303, "ab" * 3000 + "c", "src4"), (1304, "日本語😀é " * 200, "src5")]
    rows += [(1400, passage, "src6"), (1400, passage, "src6"), (1401, passage.upper(), "src6"), (1402, "line\n" * 40, "src7"), (1403, "<|endoftext|> x <|endoftext|>", "src7")]
    return [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, TEXT_SCHEMA).repartition(5, "doc_id").cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], TEXT_SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
