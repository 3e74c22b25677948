"""The few functions that columns can't express, as Arrow-batched functions."""

from __future__ import annotations

import difflib
import html
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

VULNERABILITY = StructType([StructField("cve", StringType()), StructField("cwe", StringType()), *(StructField(f"cvss_{v}_{what}", kind) for v in ("v3", "v4") for what, kind in (("score", DoubleType()), ("vector", StringType())))])
#: How an advisory states that a CVE was assigned, its weakness before that, and its scores after it.
ASSIGNED = re.compile(r"(CVE-\d{4}-\d{4,7})\s+has\s+been\s+assigned")
WEAKNESS = re.compile(r"CWE-\d{1,4}")
SCORES = {
    "v3": re.compile(r"CVSS\s*v3[^.]*?base score of\s*(\d{1,2}(?:\.\d)?)[^(]*?\(\s*(CVSS:3\.\d/[A-Z:/]+)"),
    "v4": re.compile(r"CVSS\s*v4[^.]*?base score of\s*(\d{1,2}(?:\.\d)?)[^(]*?\(\s*(AV:[NALP]/[A-Z:/]+)"),
}
BEFORE, AFTER = 700, 800


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, first argument first; null for null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """all HTML entities."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def vulnerabilities_in(text: str | None) -> list[dict]:
    """Each CVE that a text says was assigned, with the last weakness shortly before that and both scores shortly after.

    A CVE that is assigned twice keeps its first place and what its last block says; what is not stated is an empty
    string, or null for a score."""
    out: dict[str, dict] = {}
    for m in ASSIGNED.finditer(text or ""):
        ahead = text[m.start() : m.start() + AFTER]
        row = {"cve": m[1], "cwe": (["", *WEAKNESS.findall(text, max(0, m.start() - BEFORE), m.start())])[-1]}
        for version, pattern in SCORES.items():
            found = pattern.search(ahead)
            row |= {f"cvss_{version}_score": float(found[1]) if found else None, f"cvss_{version}_vector": found[2] if found else ""}
        out[m[1]] = row
    return list(out.values())


@F.pandas_udf(ArrayType(VULNERABILITY))
def parse_vulnerabilities(text: pd.Series) -> pd.Series:
    """F3, S10."""
    return text.map(vulnerabilities_in)


def clean_jsonc(text: str | None) -> str | None:
    """JSON without comments and trailing commas, strings untouched; null if that doesn't parse."""
    if text is None:
        return None
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    out = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", out, flags=re.S)
    try:
        json.loads(out)
    except ValueError:
        return None
    return out


@F.pandas_udf(StringType())
def jsonc(text: pd.Series) -> pd.Series:
    return text.map(clean_jsonc)


def best_of(known: list[str]):
    """A function of names to (best_match, score): the most similar of the known ones, the smallest of equals.

    Two names' similarity is at most twice their shared letters over both lengths. That bound is computed for all known
    names at once, and only those whose bound can still win are compared."""
    import numpy as np

    known = sorted(known)
    letters = {c: i for i, c in enumerate(sorted(set("".join(known))))}

    def counts(name: str) -> np.ndarray:
        row = np.zeros(len(letters), np.int32)
        for c in name:
            if c in letters:
                row[letters[c]] += 1
        return row

    table = np.array([counts(k) for k in known]).reshape(len(known), len(letters))
    sizes = np.array([len(k) for k in known], float)

    def best(name: str | None) -> dict | None:
        if name is None or not known:
            return None
        bound = 2 * np.minimum(table, counts(name)).sum(1) / np.maximum(sizes + len(name), 1) + (sizes + len(name) == 0)
        top: tuple[float, str | None] = (-1.0, None)
        matcher = difflib.SequenceMatcher(None)
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] < top[0] - 1e-12:
                break
            matcher.set_seqs(name, known[i])
            score = matcher.ratio()
            if score > top[0] or score == top[0] and known[i] < top[1]:
                top = (score, known[i])
        return {"best_match": top[1], "score": top[0]}

    @F.pandas_udf(StructType([StructField("best_match", StringType()), StructField("score", DoubleType())]))
    def f(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best(n) or {"best_match": None, "score": None} for n in names], columns=["best_match", "score"])

    return f
