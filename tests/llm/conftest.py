import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

LONG = "lorem ipsum dolor sit amet consectetur " * 3000
SENTENCES = [
    "The quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing in the tall green trees all day long",
    "Many hands make light work and every evening the villagers gather around the fire to tell long stories about ships and distant islands",
    "Nothing in the contract says that the second party must deliver the goods before the first of May unless both sides agree in writing",
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, `_q_text` string"


def rows():
    """Nulls, empty and very long texts, ties, repeated rows, no letters, non-Latin text, control strings."""
    texts = [
        None, "", " \n\t", "123 456 !!", "one", "Two words", SENTENCES[0], SENTENCES[0], SENTENCES[0].replace("lazy", "idle"),
        SENTENCES[1] + "\n" + SENTENCES[1], SENTENCES[2] + " " + SENTENCES[0], LONG, "<|endoftext|> don't we'll 'sand  x\n\ny",
        "Ünïcödé ñandú straße ÆØÅ çà " * 5, "日本語のテキスト 中文 русский текст", "# * $ % & | < >" * 30, "ALL CAPS HERE!! " * 20,
    ]
    out = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), 0.5, "x") for i, t in enumerate(texts)]
    return [*out, out[6], (None, SENTENCES[0], "en", None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
