"""Token counts by the whole-token shortcut, for piece models that merge pairs.

Pairs are only ever merged into vocabulary strings. So no merge crosses a place between two characters that stand side
by side in no vocabulary string, and a text can be cut at all such places without changing its tokens; such places
are found from the vocabulary alone, as is every vocabulary string that comes out as one token when it is encoded
alone: that is proved once, before any text is read, and sent to the tasks with the plan (a vocabulary's strings at
most). Slices that are such strings count one each; the others are merged by the library, each once.

Defined results: a null or empty text has no tokens; repeated rows are counted each on its own; extra columns are
ignored; an empty table gives an empty result; very long slices are given whole to the library; there are no ties.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_texts

SPACE = "▁"
#: Slices whose counts a worker remembers; beyond it, it forgets all and begins anew.
REMEMBERED = 400_000
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


class PieceCounter:
    def __init__(self, model: str, whole: list[str] | None = None):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [p for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i) or self.sp.is_byte(i)) for p in [self.sp.id_to_piece(i)]]
        if any(p != SPACE * len(p) and SPACE in p[1:] for p in plain):
            raise ValueError("a vocabulary string holds a space after other characters; texts can't be cut before spaces")
        inner = {c for p in plain if len(p) > 1 for c in p}
        #: A character in no longer string is a slice of its own. Other slices are cut before each run of spaces.
        self.alone = "".join(c for c in [*map(chr, range(32)), "\x7f"] if c not in inner)
        self.cut = re.compile(rf"[{re.escape(self.alone)}]|{SPACE}*[^{re.escape(self.alone)}{SPACE}]+|{SPACE}+")
        #: Vocabulary strings that encode alone as one token, by proof if they aren't given.
        self.whole = dict.fromkeys([p for p, n in zip(plain, self._counts(plain), strict=True) if n == 1] if whole is None else whole, 1)
        self.known: dict[str, int] = dict(self.whole)

    def _counts(self, slices: list[str]) -> list[int]:
        """The library puts a space before each text; slices that begin otherwise follow a newline, which joins nothing."""
        spaced = [s[1:] if s[0] == SPACE and len(s) > 1 else "\n" + s for s in slices]
        extra = [0 if s[0] == SPACE and len(s) > 1 else 2 for s in slices]
        return [len(x) - e for x, e in zip(self.sp.encode(spaced, num_threads=1), extra, strict=True)]

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [self.cut.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = dict(self.whole)
        known = self.known
        new = list({s for slices in cut for s in slices if s not in known})
        for at in range(0, len(new), 50_000):
            known.update(zip(new[at : at + 50_000], self._counts(new[at : at + 50_000]), strict=True))
        return [sum(map(known.__getitem__, slices)) for slices in cut]


@lru_cache(maxsize=2)
def prove(model: str) -> list[str]:
    """The vocabulary strings that encode alone as one token."""
    return list(PieceCounter(model).whole)


_COUNTERS: dict[str, PieceCounter] = {}


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """n_bytes, n_tokens and over_limit for each row of docs(doc_id, text). model is a path that executors can open. Narrow."""
    proved = docs.sparkSession.sparkContext.broadcast(prove(model))  # a vocabulary's strings at most

    def fn(piece):
        if model not in _COUNTERS:
            _COUNTERS[model] = PieceCounter(model, proved.value)
        n = _COUNTERS[model].count(piece["text"])
        return {"doc_id": piece["doc_id"], "n_bytes": [len((t or "").encode()) for t in piece["text"]], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(docs, fn, SCHEMA)
