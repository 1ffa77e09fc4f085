"""Token ids of a word vocabulary whose tokens never cross white space.

The library merges within pre-tokens, and white space only ends those. Texts of ASCII and Latin-1 letters alone are cut into
the pre-tokens that the library would make of them, all texts of a batch at once in Arrow: pre-tokens are numbered by a
dictionary, each that a worker doesn't remember is merged once, and taking the dictionary's ids by number leaves every
text's ids side by side. In other texts, words of such letters are cut likewise, and any other word, as one that may hold a
special token, goes to the library whole. Very long texts are taken in slices that end at white space.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import batches, bounded

#: Pre-tokens and words whose ids a worker remembers, and once more as many of those that it met before these.
REMEMBERED = 300_000
#: Bytes of a text that are split at once.
SLICE = 1 << 20
SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
#: ASCII without controls, and Latin-1 letters: lower case is by character and composition changes nothing.
PLAIN = r"!-~\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xff"
WHITE = r" \t\n\r\x0b\x0c"
PLAIN_TEXT, PLAIN_WORD, WORD = re.compile(f"[{PLAIN}{WHITE}]*"), re.compile(f"[{PLAIN}]+"), re.compile(f"[^{WHITE}]+")
LETTERS, DIGITS = r"a-z\x{aa}\x{b5}\x{ba}\x{df}-\x{f6}\x{f8}-\x{ff}", r"0-9\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}"
#: What the vocabulary's own pattern takes of lower-cased plain text beside runs of letters, for Arrow's expressions.
BETWEEN = rf"'(?:s|t|re|ve|m|ll|d)|[{DIGITS}]|[^{LETTERS}{DIGITS} \t\n\r\x{{0b}}\x{{0c}}]+"


class Remembered:
    """A dictionary that forgets what wasn't met for long: beyond REMEMBERED entries, it keeps them apart until it has as many again."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.now) > REMEMBERED:
            self.now, self.former = {}, self.now

    def missing(self, keys: set[str]) -> list[str]:
        """Those of keys that it doesn't know; what it knows from before is at hand again."""
        known = {k for k in keys if k in self.former}
        self.now.update(zip(known, map(self.former.__getitem__, known), strict=True))
        return list(keys - known)
SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        #: Its merges alone, for pre-tokens that are cut already, written in the characters that stand for bytes.
        self.merges = Tokenizer(self.library.model)
        stands = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        stands |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in stands)}
        self.bytewise = {c: "".join(stands[b] for b in chr(c).encode()) for c in range(128, 256)}
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = Remembered()

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, parts: list[str]) -> Iterator[bytes]:
        """Each part is one pre-token, which ends with the only one of its tokens that ends a word."""
        for at in range(0, len(parts), 1000):
            some = [p if p.isascii() else p.translate(self.bytewise) for p in parts[at : at + 1000]]
            ids = np.array(self.merges.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the vocabulary doesn't mark the end of each word")
            raw, begin = ids.tobytes(), 0
            for end in (ends * 4).tolist():
                yield raw[begin:end]
                begin = end

    def _whole(self, words: list[str]) -> Iterator[bytes]:
        for at in range(0, len(words), 1000):
            yield from (ids.tobytes() for ids in self._encoded(words[at : at + 1000]))

    def _ids(self, units: list[str]) -> list[bytes]:
        """Ids of pre-tokens and of words that aren't plain, each learnt if it isn't remembered."""
        self.known.turn()
        now = self.known.now
        found = list(map(now.get, units))
        gaps = [i for i, x in enumerate(found) if x is None]
        parts, words = [], []
        for p in self.known.missing({units[i] for i in gaps}):
            (parts if PLAIN_WORD.fullmatch(p) and "<|" not in p else words).append(p)
        now.update(zip(parts, self._merged(parts), strict=True))
        now.update(zip(words, self._whole(words), strict=True))
        for i in gaps:
            found[i] = now[units[i]]
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned numbers of 32 bits."""
        plain, odd = [], {}
        for i, raw in enumerate(texts):
            text = raw.decode(errors="replace")
            if not PLAIN_TEXT.fullmatch(text) or "<|" in text:
                words = WORD.findall(text)
                odd[i] = {j: w for j, w in enumerate(words) if not PLAIN_WORD.fullmatch(w) or "<|" in w}
                # stands for a word that isn't plain; no plain one holds it
                text = "\n".join("\x00" if j in odd[i] else w for j, w in enumerate(words))
            plain.append(text.lower())
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pa.array(plain, pa.string()), pattern=BETWEEN, replacement=r" \0 "))
        numbered = cut.flatten().dictionary_encode()
        units = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = {"": b"", "\x00": b""}
        named = [u for u in units if u not in known]
        known |= zip(named, self._ids(named), strict=True)
        taken = pa.array([known[u] for u in units], pa.binary()).take(numbered.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1]
        data = memoryview(taken.buffers()[2] or b"")
        at = cut.offsets.to_numpy()
        out = [bytes(data[ends[a] : ends[b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
        for i, words in odd.items():
            places = [j for j, u in enumerate(cut[i].as_py()) if u == "\x00"]
            ids, begin, parts = self._ids(list(words.values())), ends[at[i]], []
            for place, more in zip(places, ids, strict=True):
                here = ends[at[i] + place]
                parts += [bytes(data[begin:here]), more]
                begin = here
            out[i] = b"".join([*parts, bytes(data[begin : ends[at[i + 1]]])])
        return out

    def encode_long(self, text: bytes) -> bytes:
        return b"".join(self.encode([s])[0] for s in slices(text))


SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def slices(text: bytes) -> Iterator[bytes]:
    """The text in parts of SLICE bytes and up to the next white space."""
    begin = 0
    while begin < len(text):
        found = SPACE.search(text, begin + SLICE)
        end = found.start() if found else len(text)
        yield text[begin:end]
        begin = end


_ENCODERS: dict[str, WordIds] = {}


def pieces(docs: DataFrame, path: str, most: int, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned numbers of 32 bits) of each row of docs(doc_id, text): its
    ids, then the id `end`, cut into pieces of `most` ids, the last of which may be shorter. path can be opened by executors."""
    close = np.array([end], "<u4").tobytes()

    def run(rows):
        if path not in _ENCODERS:
            _ENCODERS[path] = WordIds(path)
        encoder = _ENCODERS[path]
        for batch in batches(rows):
            texts = [t or b"" for t in batch["text"]]
            encoded = [encoder.encode_long(texts[0])] if len(texts) == 1 else encoder.encode(texts)
            out: list[tuple] = []
            held = 0
            for doc_id, ids in zip(batch["doc_id"], encoded, strict=True):
                ids += close
                for piece, at in enumerate(range(0, len(ids), 4 * most)):
                    part = ids[at : at + 4 * most]
                    out.append((doc_id, piece, at // 4, len(part) // 4, part))
                    held += len(part)
                    if held > 8 << 20:
                        yield _batch(out)
                        out, held = [], 0
            yield _batch(out)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return bounded(texts).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])
