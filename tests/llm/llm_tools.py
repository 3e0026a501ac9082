"""Small documents and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re

NOT_SPACE = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None, pattern: re.Pattern = NOT_SPACE) -> list[str]:
    return pattern.findall(text or "")


def sentence(r: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{r.randrange(vocabulary):x}" for _ in range(n))


def documents(spark, rows):
    """(doc_id, text) rows with columns whose names the operators use themselves."""
    full = [(i, t, "en", "src1", None if t is None else len(t), "kept?", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key string, part int")
