"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, in numpy.

A document is rejected when it has too few words, when too many of its words stand in repeated three-word
windows, or when the characters inside duplicated lines or duplicated word n-grams make up too large a share of
all word characters. Everything is computed over whole texts, many documents at a time in one array.

Defined results: a null or empty text has no words and fails the base rule; a text of white space alone likewise;
very long texts are measured whole; a share at its limit is kept; repeated rows are judged each on its own; extra columns
are ignored (`quality_rules`) or kept (`keep_good`); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import bounded, map_texts
from .hashing import Rolling, mix64

SYMBOLS = "#*$%&|<>"
PIECE = 1_000_000
SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, dup_line_share double, ngram_shares array<double>"
)


@dataclass(frozen=True)
class Rules:
    """Shares of word characters inside duplicated lines and inside duplicated n-grams, and
    symbols a word, above which a text is rejected."""

    min_words: int = 50
    repeat_window: int = 3
    repeat_percent: int = 50
    dup_line_share: float = 0.30
    symbols_per_word: float = 0.30
    ngram_share: dict[int, float] = field(default_factory=lambda: {5: 0.30, 6: 0.28, 8: 0.25, 10: 0.22})


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True for each key found twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    flags = np.zeros(len(keys), bool)
    flags[order[1:]] |= same
    flags[order[:-1]] |= same
    return flags


def _later(keys: np.ndarray, order_of: np.ndarray) -> np.ndarray:
    """True for each key equal to an earlier one; order_of is ascending in reading order."""
    order = np.lexsort((order_of, keys))
    ranked = keys[order]
    flags = np.zeros(len(keys), bool)
    flags[order[1:]] = ranked[1:] == ranked[:-1]
    return flags


def measure(texts: list[str | None], rules: Rules = Rules()) -> dict:
    """All figures of a list of texts."""
    raw = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    n_docs = len(raw)
    # each text is followed by one newline, which belongs to no word and ends its last line
    codes = np.frombuffer(b"\n\0\0\0".join(raw) + b"\n\0\0\0", np.uint32) if n_docs else np.zeros(0, np.uint32)
    sizes = np.fromiter((len(r) // 4 for r in raw), np.int64, n_docs)
    bounds = np.zeros(n_docs + 1, np.int64)
    np.cumsum(sizes + 1, out=bounds[1:])
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    symbol = np.isin(codes, np.array([ord(c) for c in SYMBOLS], np.uint32))
    word_chars, n_symbols = _sums(~space, bounds), _sums(symbol, bounds)
    roll = Rolling(codes)

    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    doc = np.searchsorted(bounds, starts, "right") - 1
    n_words = np.bincount(doc, minlength=n_docs)
    first = np.zeros(n_docs + 1, np.int64)
    np.cumsum(n_words, out=first[1:])
    words = roll.of(starts, ends)
    lengths = ends - starts
    chars_to = np.zeros(len(words) + 1, np.int64)
    np.cumsum(lengths, out=chars_to[1:])
    salt = mix64(doc.astype(np.uint64) + np.uint64(7))
    sequence = Rolling(words)

    def covered(n: int) -> np.ndarray:
        """Words inside an n-word window found twice or more in its document."""
        flags = np.zeros(len(words), bool)
        at = np.arange(max(0, len(words) - n + 1))
        at = at[doc[at] == doc[at + n - 1]] if len(at) else at
        if len(at):
            hit = at[_repeated(mix64(sequence.of(at, at + n) ^ salt[at]))]
            delta = np.zeros(len(words) + 1, np.int32)
            np.add.at(delta, hit, 1)
            np.add.at(delta, hit + n, -1)
            flags = np.cumsum(delta[:-1]) > 0
        return flags

    n_repeat = np.bincount(doc[covered(rules.repeat_window)], minlength=n_docs)
    # lines
    line_ends = np.flatnonzero(codes == 10)
    line_starts = np.concatenate(([0], line_ends[:-1] + 1)) if len(line_ends) else line_ends
    inside = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(~space, out=inside[1:])
    held = inside[line_ends] - inside[line_starts]
    real = held > 0
    line_starts, line_ends, held = line_starts[real], line_ends[real], held[real]
    line_doc = np.searchsorted(bounds, line_starts, "right") - 1
    keys = mix64(roll.of(line_starts, line_ends) ^ mix64(line_doc.astype(np.uint64) + np.uint64(7)))
    later = _later(keys, line_starts)
    n_dup = np.bincount(line_doc[later], minlength=n_docs)
    total = np.maximum(word_chars, 1)
    line_share = np.bincount(line_doc[later], held[later], n_docs) / total
    shares = {n: np.bincount(doc[c := covered(n)], lengths[c], n_docs) / total for n in rules.ngram_share}
    failed = (n_words < rules.min_words) | (100 * n_repeat > rules.repeat_percent * n_words)
    kept = ~failed & (n_symbols <= rules.symbols_per_word * n_words) & (line_share <= rules.dup_line_share)
    for n, most in rules.ngram_share.items():
        kept &= shares[n] <= most
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "base_failed": failed, "kept": kept,
        "dup_line_share": line_share, "ngram_shares": list(np.stack(list(shares.values()), 1)) if shares and n_docs else [[]] * n_docs,
    }


def measure_all(texts: list[str | None], rules: Rules = Rules()) -> dict:
    """measure() over pieces of at most PIECE characters, or of one longer text; its arrays are many times their size."""
    parts, begin, held = [], 0, 0
    for i, text in enumerate(texts):
        size = len(text or "") + 1
        if i > begin and held + size > PIECE:
            parts.append(measure(texts[begin:i], rules))
            begin, held = i, 0
        held += size
    parts.append(measure(texts[begin:], rules))
    return {k: [x for p in parts for x in p[k]] if k == "ngram_shares" else np.concatenate([p[k] for p in parts]) for k in parts[0]}


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row of figures and a verdict for each row of docs(doc_id, text). Narrow: no shuffle."""
    return map_texts(docs, lambda piece: measure_all(piece["text"], rules) | {"doc_id": piece["doc_id"]}, SCHEMA)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. Narrow: the verdict is taken while rows pass."""
    import pyarrow as pa

    def run(rows):
        for batch in rows:
            if batch.num_rows:
                yield batch.filter(pa.array(measure_all(batch.column("text").to_pylist(), rules)["kept"]))

    return bounded(docs).mapInArrow(run, docs.schema)
