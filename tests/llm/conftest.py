from __future__ import annotations

import random
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and market order price book trade maker taker spread depth queue level event flow under over with from that this would could should".split(),
    "de": "der die das und nicht markt preis buch handel tiefe stufe ereignis fluss unter mit von dass dieser würde könnte sollte größe straße über".split(),
}


def prose(seed: int, n: int, lang: str = "en") -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + (f"{r.randrange(40)}" if r.random() < 0.2 else "") for _ in range(n))


def rows() -> list[tuple]:
    """Texts of every odd kind: null, empty, blank, symbols, very long, copies, near copies, shared passages, repeated rows."""
    base = prose(1, 120)
    passage = prose(2, 70)
    out = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base.replace(" ", "  \n"), "en", "b", None), (4, None, None, None, None), (5, "", "en", "a", 0),
        (6, " \t\n ", "de", "b", 3), (7, "!!! ??? 123", None, "a", 1), (8, base.replace("price", "prices", 1), "en", "b", 2), (9, prose(3, 40) + " " + passage, "en", "a", 5),
        (10, passage + " " + prose(4, 30), "en", "a", 5), (11, prose(5, 6000), "en", "a", 5), (12, "a", "en", "a", 1), (13, "one two three", "en", "b", 1), (14, "one two three", "en", "b", 1),
        (15, prose(6, 90, "de"), "de", "b", 9), (16, prose(6, 90, "de"), "de", "b", 9), (17, "x" * 5000, "en", "a", 5000), (18, "中文 文本 😀 naïve <|endoftext|> don't", None, "c", 1),
        (None, base, "en", "a", 1), (None, prose(7, 60), None, None, None), (9, prose(3, 40) + " " + passage, "en", "a", 5), (20, "All Rights Reserved. MIT License; cc-by 4.0, CC BY", "en", "a", 1),
    ]
    return out + [(100 + k, prose(100 + k, 30 + k % 50, "en" if k % 3 else "de"), "en" if k % 3 else "de", f"s{k % 4}", k) for k in range(40)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHES = "kept key row rep hub bands label id src a b lng top tokens weight packed runs least held_out score term __row __id bucket text_sha256 squeezed topic".split()


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with extra columns named like an operator's own."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit("x").alias(c) for c in CLASHES])


def crc(i: int | None, n: int) -> int | None:
    return None if i is None else zlib.crc32(str(i).encode()) % n
