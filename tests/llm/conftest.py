import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LONG = " ".join(random.Random(5).choice(["alpha", "beta", "Gamma.", "ñandú", "12,5", "x!"]) for _ in range(20_000))

#: Null, empty, blank, very long, tied, repeated and odd texts.
ODD = [None, "", "   \n\t ", "\n\n", LONG, LONG + " end", "The same line.\nAnother one here.", "The same line.\nAnother one here.", "a", "a" * 5000, "x\u00a0y\u2003z \u3000",
       "<|endoftext|> and <|ENDOFTEXT|>", "É. ≠ ́. 12 34", "\x00\x1c\x85 nul", "I'll don't IT'S", "日本語 のテキスト。", "🙂🙂 ok"]


@pytest.fixture(scope="session")
def odd_rows():
    return list(enumerate(ODD))


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with columns whose names the operators use themselves."""
    rows = [(i, x, "en", "s", 1, 2.0, "x") for i, x in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, mark string").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def real(spark, sf_dir):
    """(id, text) of the generated documents."""
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
