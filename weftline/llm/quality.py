"""Line-first quality rules.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere; other blanks, such as the no-break space before French marks, are part of a word.
Every line with a word is judged by itself. It fails by
- *punctuation*: it has fewer than five words, no closing mark at its end and no full stop, exclamation or question mark inside;
- *navigation*: two or more separators, at least one to five words, or a line of at most 12 words a third of which are menu words;
- *boilerplate*: notices (licence, cookies, rights) in a line of at most ten words for each, a repeated
  earlier line of the text, mostly symbols or capitals, or one word that fills most of it.
Failing lines are removed, and a document that keeps less than ``min_kept`` of its word characters is rejected,
as is one that fails the base rules (too short, or too much of it in repeated windows).

One pass over each text in its own task, no shuffle. A null text has no words and fails the base rules, as does an
empty one; a null id is passed through; repeated rows are judged alike; a very long text is judged whole, in memory a few times its
size; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
ENDS = tuple(".!?:;…\"'”’»)]。！？")
NAVIGATION = re.compile(r"\b(?:home|menu|login|log in|sign up|sign in|next|previous|prev|share|tweet|contact us|about us|sitemap|back to top|read more|click here|breadcrumb)\b", re.ASCII)
NOTICES = re.compile(r"\b(?:all rights reserved|licensed under|licenced under|released under the|creative commons|terms of use|terms of service|privacy policy|cookies?|javascript|subscribe|newsletter|copyright)\b|©", re.ASCII)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MULT = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, kept_chars long, lines_failed string, cleaned string"


def repeat_words(words: list[bytes], window: int = 8) -> int:
    """Words inside a ``window``-word window whose word sequence occurs twice or more in ``words``."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key += h[k : k + n] * _MULT[k]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_fault(line: str, seen: bool) -> str | None:
    """The rule that ``line`` fails, or None."""
    low = line.lower()
    words = WORD.findall(line)
    n = len(words)
    if seen or n <= 10 * len(NOTICES.findall(low)):
        return "boilerplate"
    bars = line.count("|") + line.count("»") + line.count("›")
    if bars >= 2 and 5 * bars >= n or n <= 12 and 3 * len(NAVIGATION.findall(low)) >= n:
        return "navigation"
    symbols = sum(map(line.count, SYMBOLS))
    if 10 * symbols > n and symbols >= 3:
        return "boilerplate"
    if n >= 4 and 10 * sum(w.upper() == w != w.lower() for w in words) > 7 * n and len(line) > 12:
        return "boilerplate"
    if n >= 8 and (3 * Counter(words).most_common(1)[0][1] > n or 5 * sum(map(eq, words, words[1:])) > 2 * n):
        return "boilerplate"
    if not line.rstrip(SPACE).endswith(ENDS) and not any(c in line for c in ".!?。") and n < 5:
        return "punctuation"
    return None


def judge(text: str | None, min_words: int = 20, max_repeat: int = 30, min_kept: float = 0.5) -> tuple:
    """The columns of ``SCHEMA`` after ``doc_id``."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words, word_chars = len(words), len(text) - sum(map(text.count, SPACE))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    kept, faults, dups, kept_chars = [], {}, 0, 0
    for line in text.split("\n"):
        chars = len(line) - sum(map(line.count, SPACE))
        if not chars:
            kept.append(line)
            continue
        again = line in seen
        seen.add(line)
        dups += again
        fault = line_fault(line, again)
        if fault is None:
            kept.append(line)
            kept_chars += chars
        else:
            faults[fault] = faults.get(fault, 0) + 1
    repeats = repeat_words(words)
    failed = n_words < min_words or 100 * repeats > max_repeat * n_words
    verdict = not failed and kept_chars >= min_kept * word_chars
    return n_words, word_chars, n_symbols, dups, repeats, failed, verdict, kept_chars, ",".join(f"{k}={v}" for k, v in sorted(faults.items())), "\n".join(kept)


def line_first(docs: DataFrame, min_words: int = 20, max_repeat: int = 30, min_kept: float = 0.5, cleaned: bool = True) -> DataFrame:
    """One row per document with its measures, the verdict and, if asked for, the text without its failing lines."""
    fields = SCHEMA.split(", ")[: None if cleaned else -1]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    names, types = [x.split()[0] for x in fields], [kinds[x.split()[1]] for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [judge(x.as_py(), min_words, max_repeat, min_kept)[: len(names) - 1] for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types[1:]))], names=names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, ", ".join(fields))


def keep(docs: DataFrame, min_words: int = 20, max_repeat: int = 30, min_kept: float = 0.5) -> DataFrame:
    """``docs`` without the rejected ones and, of the others, without the failing lines; same columns.

    ``text`` is replaced, and ``n_chars`` where there is one; all other columns pass through as they are.
    """
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                rows = [judge(x.as_py(), min_words, max_repeat, min_kept) for x in part.column(at)]
                columns = list(part.columns)
                texts = [r[-1] for r in rows]
                columns[at] = pa.array(texts, part.schema.field(at).type)
                if chars is not None:
                    columns[chars] = pa.array([len(x) for x in texts]).cast(part.schema.field(chars).type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names).filter(pa.array([r[6] for r in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
