"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file and composed with each input:

* the normaliser rewrites characters (space to U+2581, and one put in front);
* the piece transducer, a trie, reads characters and writes piece numbers; a
  character without a piece of its own goes over the arcs of its UTF-8 bytes;
* the weight machine. For unigram models an arc weighs minus its piece's score.
  For BPE models, whose segmentation is no sum of scores, it accepts piece
  bigrams: a pair weighs 0 if merging its text gives that very pair, else
  infinity. A sequence all of whose neighbours pass is the one that merging
  gives, so that exactly one path has a finite weight.

The output is the path of least weight in the tropical semiring (min, +). No
piece has U+2581 behind another character, none spans a line feed, and some
marks never stand behind letters in one, so paths are found once per such
segment and kept in a bounded table.

Null text gives null pieces and null text; the empty text gives no pieces.
Decoding gives the text back exactly, but for U+2581 itself, which reads as a
space. Only models with the identity normaliser are compiled. Rows that repeat
a doc_id are rows of their own; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ionflow.llm import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Segments whose paths are kept, and bigrams whose weights are.
KEPT = 500_000
INFINITY = float("inf")


def load(path: str) -> dict:
    """What the machines are compiled from: pieces, scores, kinds, normaliser settings."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models with the identity normaliser are supported")
    kind = {1: "normal", 4: "normal", 6: "byte"}
    return {
        "bpe": model.trainer_spec.model_type == 2,
        "prefix": norm.add_dummy_prefix,
        "pieces": [(p.piece, p.score, kind.get(p.type, "control")) for p in model.pieces],
    }


class Transducer:
    """The composed machine of one model."""

    def __init__(self, model: dict):
        self.bpe, self.prefix = model["bpe"], model["prefix"]
        self.score = [s for _, s, _ in model["pieces"]]
        self.ids = {p: k for k, (p, _, kind) in enumerate(model["pieces"]) if kind == "normal"}
        self.bytes = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(model["pieces"]) if kind == "byte"}
        text = [b"" if kind == "control" else bytes([int(p[3:5], 16)]) if kind == "byte" else p.replace(SPACE, " ").encode() for p, _, kind in model["pieces"]]
        self.text = text
        self.trie: dict = {}
        for p, k in self.ids.items():
            node = self.trie
            for ch in p:
                node = node.setdefault(ch, {})
            node[0] = k
        inner = {ch for p in self.ids if len(p) > 1 for ch in p}
        # marks that no piece has behind a letter or digit: a segment may end before them
        word = re.compile(r"\w")
        marks = set(string.punctuation) - {"_"} - {y for p in self.ids for x, y in zip(p, p[1:]) if word.match(x)}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or "\n" in inner:
            self.segment = re.compile(r"(?s).+")
        elif marks:
            m = re.escape("".join(sorted(marks)))
            self.segment = re.compile(rf" *[^ \n\w]*\w+(?=[{m}])| *[^ \n]+| +|\n")
        else:
            self.segment = re.compile(" +[^ \n]*|\n|[^ \n]+")
        self.kept: dict[str, bytes] = {}
        self.pair: dict[int, float] = {}
        self.made: dict[int, list | None] = {}
        self.names = [p for p, _, _ in model["pieces"]]

    def merges(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """BPE of a short string by its definition: merge the best pair, leftmost first, while there is one.

        Returns the parts, and of each merge minus its score and the first and last part after it.
        """
        parts, steps = list(text), []
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return parts, steps
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((-best, parts[0], parts[-1]))

    def _steps(self, piece: int) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece, or None if merging its text never makes it."""
        if piece not in self.made:
            parts, steps = self.merges(self.names[piece])
            self.made[piece] = steps if len(parts) == 1 else None
        return self.made[piece]

    def bigram(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b gives the two: no merge across comes before their own are done."""
        one, two = self._steps(a), self._steps(b)
        if one is None or two is None:
            return False
        # before any merge the neighbours are the last character of a and the first of b
        last, first, i, j = self.names[a][-1], self.names[b][0], 0, 0
        while True:
            across = self.ids.get(last + first)
            r = INFINITY if across is None else -self.score[across]
            x = one[i][0] if i < len(one) else INFINITY
            y = two[j][0] if j < len(two) else INFINITY
            if x == y == r == INFINITY:
                return True
            if x <= r and x <= y:
                last = one[i][2]
                i += 1
            elif y < r:
                first = two[j][1]
                j += 1
            else:
                return False

    def _bpe_path(self, s: str) -> list[int]:
        """Least path over the composition with s, arcs relaxed in (min, +) from left to right.

        A state is a position with the piece that ends there. Each beginning of s
        has one path of finite weight, so that a position keeps one state; weights
        are no less than 0, so that an arc to one no heavier is not composed.
        """
        n, root, pair, width = len(s), self.trie, self.pair, len(self.names)
        weight = [INFINITY] * (n + 1)
        weight[0] = 0.0
        into, start = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            here = weight[i]
            if here == INFINITY:
                continue
            last, node, j = into[i], root, i
            base = last * width
            while j < n:
                node = node.get(s[j])
                if node is None:
                    break
                j += 1
                if 0 in node and here < weight[j]:
                    piece = node[0]
                    arc = pair.get(base + piece)
                    if arc is None:
                        if len(pair) >= KEPT:
                            pair.clear()
                        ok = self.bigram(last, piece) if last >= 0 else self._steps(piece) is not None
                        arc = pair[base + piece] = 0.0 if ok else INFINITY
                    if here + arc < weight[j]:
                        weight[j], into[j], start[j] = here + arc, piece, i
            if 0 not in root.get(s[i], ()) and here < weight[i + 1]:  # the arcs of its bytes
                weight[i + 1], into[i + 1], start[i + 1] = here, -1, i
        if weight[n] == INFINITY:
            raise ValueError(f"no path for {s!r}")
        out, j = [], n
        while j > 0:
            i, piece = start[j], into[j]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.bytes[b] for b in reversed(s[i:j].encode())]
            j = i
        return out[::-1]

    def _unigram_path(self, s: str) -> list[int]:
        """The path of least summed weight; ties go to the longer last piece."""
        n, lost = len(s), 10.0 - min(self.score)
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)] + [(INFINITY, 0, -1)] * n
        for i in range(n):
            w, node, j = best[i][0], self.trie, i
            while j < n:
                node = node.get(s[j])
                if node is None:
                    break
                j += 1
                if 0 in node and w - self.score[node[0]] < best[j][0]:
                    best[j] = (w - self.score[node[0]], i, node[0])
            if s[i] not in self.trie or 0 not in self.trie[s[i]]:
                if w + lost < best[i + 1][0]:
                    best[i + 1] = (w + lost, i, -1)
        out, j = [], n
        while j > 0:
            _, i, piece = best[j]
            out.append([self.bytes[b] for b in s[i:j].encode()] if piece < 0 else [piece])
            j = i
        return [p for part in reversed(out) for p in part]

    def shortest(self, s: str) -> list[int]:
        """The least-weight path over the composition with s (normalised)."""
        return self._bpe_path(s) if self.bpe else self._unigram_path(s)

    def _miss(self, seg: str) -> bytes:
        if len(self.kept) >= KEPT:
            self.kept.clear()
        out = self.kept[seg] = np.array(self.shortest(seg.replace(" ", SPACE)), "<u4").tobytes()
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        kept, out = self.kept, []
        for seg in self.segment.findall((" " + text if self.prefix else text).replace(SPACE, " ")):
            out.append(kept.get(seg) or self._miss(seg))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids) -> str:
        raw = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if self.prefix and raw[:1] == " " else raw


_MACHINES: dict[str, Transducer] = {}


def machine(model: dict) -> Transducer:
    """One machine a worker process, whose tables outlast a task."""
    key = hashlib.md5(repr((model["bpe"], model["prefix"], len(model["pieces"]), model["pieces"][-5:], model["pieces"][300:310])).encode()).hexdigest()
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = Transducer(model)
    return _MACHINES[key]


def _ids(arrays: list[np.ndarray | None]) -> pa.Array:
    ends = np.cumsum([0] + [0 if a is None else len(a) for a in arrays]).astype(np.int32)
    values = np.concatenate([a for a in arrays if a is not None] or [np.zeros(0, np.uint32)]).astype(np.int32)
    valid = pa.array([a is not None for a in arrays])
    offs = pa.array(ends, mask=np.append(~valid.to_numpy(zero_copy_only=False), False)) if not all(valid.to_pylist()) else pa.array(ends)
    return pa.ListArray.from_arrays(offs, pa.array(values))


def _encoder(model: dict, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = machine(model)
        for b in batches:
            at = 0
            while at < b.num_rows:  # a few MB at once
                ids, exact, digest, size, start = [], [], [], 0, at
                while at < b.num_rows and size < (4 << 20):
                    text = b.column(1)[at].as_py()
                    at += 1
                    if text is None:
                        ids.append(None)
                        exact.append(None)
                        digest.append(None)
                        continue
                    size += len(text)
                    got = fst.encode(text)
                    ids.append(got)
                    if check:
                        back = fst.decode(got.tolist())
                        exact.append(back == text)
                        digest.append(hashlib.sha256(back.encode()).hexdigest())
                cols = [b.column(0).slice(start, at - start), _ids(ids)]
                names = ["doc_id", "ids"]
                if check:
                    cols += [pa.array(digest, pa.string()), pa.array(exact, pa.bool_())]
                    names += ["decoded_sha256", "exact"]
                yield pa.record_batch(cols, names=names)

    return run


def encode(spark: SparkSession, docs: DataFrame, path: str = MODEL, check: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row and, with check, the decoded text's SHA-256 and whether it is the text."""
    common.ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, ids array<int>" + (", decoded_sha256 string, exact boolean" if check else "")
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_encoder(load(path), check), shape)
    return out.select("doc_id", F.array_size("ids").cast("long").alias("n_tokens"), "ids", *(["decoded_sha256", "exact"] if check else []))


def decode(spark: SparkSession, rows: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    common.ship(spark)
    model = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = machine(model)
        for b in batches:
            texts = [None if x is None else fst.decode(x) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
