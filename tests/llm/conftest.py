import random

import pytest

BASE = "the of and to in is that for with as on are this be by or was at from it an have not they you one all".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [r.choice(BASE) if r.random() < 0.4 else "".join(r.choice(["ta", "re", "on", "é", "shi", "lo", "ne", "ka"]) for _ in range(r.randint(2, 4))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def texts() -> list:
    """Short, long, empty, null, repeated, hot and odd texts."""
    out = [prose(k, 40 + 7 * k) for k in range(24)]
    out += [None, "", " ", "\n\n", "word", "one two three", "ÀÉ ñ 日本語 🎉 don't\x00x\x1cy a\u0085b c", out[3], out[3], None, ""]
    out += [out[5][:150] + " changed " + out[5][150:], "lead " + out[6][40:] + " tail"]
    out += ["spam spam spam eggs\n" * 60, prose(99, 6000), "x" * 30_000, "a b " * 3000]
    out += ["Ends <|endoftext|> and <|startoftext|>begins", "日本<|endoftext|>語 <|ENDOFTEXT|>"]
    return out


ROWS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, N_HIT string, score string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, ties, repeated rows and clashing extra columns."""
    rows = [(3 * k, x, None, "s0" if k % 3 else None, len(x or ""), -1, "?", None) for k, x in enumerate(texts())]
    rows += [rows[2], (None, prose(7, 60), "en", "s1", 0, 0, None, "x")]
    return spark.createDataFrame(rows, ROWS).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ROWS)
