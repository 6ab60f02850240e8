"""A folder of small tables: the smallest driver tables, with awkward rows added."""

import pandas as pd
import pytest

SOURCE = "/root/testdata/sf0.001"
WORDS = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(400)]


def awkward() -> list[tuple]:
    base = " ".join(WORDS[:200])
    return [
        (900001, None, "en", "x"),
        (900002, "", None, "x"),
        (900003, " \n\t ", "en", None),
        (900004, "one two", "en", "x"),
        (900005, "one two", "en", "x"),
        (900006, base, "en", "x"),
        (900007, base + " tail", "en", "x"),
        (900008, base.upper() + " tail more", "en", "x"),
        (900009, "it's <|endoftext|> <s> naïve café 你好 12345 !!!\n\n    end'LL they'll", "fr", "x"),
        (900010, "x" * 30_000, "en", "x"),
        (900011, " ".join(WORDS) * 40, "en", "x"),
        (900012, "🙂👩‍🔬 é \u0085   \x0b\x0c\x1c a\r\nb ", None, "x"),
        (900013, "same line here\n" * 80, "en", "x"),
        (900014, "# * $ % & | < > " * 40, "en", "x"),
    ]


@pytest.fixture(scope="session")
def docs():
    known = pd.read_parquet(f"{SOURCE}/documents.parquet")[["doc_id", "text", "lang", "source"]]
    return pd.concat([known, pd.DataFrame(awkward(), columns=known.columns)], ignore_index=True)


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """documents (with n_chars and an extra column whose name clashes), labels and conversations."""
    top = str(tmp_path_factory.mktemp("tables"))
    clean = docs.astype(object).where(docs.notna(), None)
    rows = [(int(i), t, lang, s, len(t or ""), "extra", "w") for i, t, lang, s in clean.itertuples(index=False)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, node string")
    frame.repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.read.parquet(f"{SOURCE}/labels.parquet").write.parquet(f"{top}/labels.parquet")
    spark.read.parquet(f"{SOURCE}/conversations.parquet").write.parquet(f"{top}/conversations.parquet")
    return top


@pytest.fixture(scope="session")
def empty_folder(spark, folder, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "conversations"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{top}/{name}.parquet")
    return top
