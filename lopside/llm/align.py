"""Alignment of the tokens of two tokenizers over the same bytes.

Both tokenizers cut a text's bytes into tokens. Per batch, and keyed by
document, ``merge_asof`` finds for each token start the token of the other side
that covers it; both directions together are all overlapping pairs. Pairs that
end together are links, and their ends cut the tokens into groups.

How often an id pair is linked in the whole corpus is counted by Spark: a block of
a few megabytes of text gives its distinct pairs with their numbers, sums are
taken by pair, the highest is found by B id, and each block gets back the rows
of its own pairs. No group holds more than a block's pairs, one pair's blocks, or
the A ids that share a B id.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lopside.llm import kernel
from lopside.session import materialize

BATCH_BYTES = 1 << 20
BLOCK_BYTES = 16 << 20

CACHED_PIECES = 250_000  # pieces of text whose tokens a worker keeps
CACHED_LENGTH = 48  # letters of a piece that is kept

#: What any notion of white space or of invisible signs could hold.
_UNSAFE = r"\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u2581\u3000\ufeff"
#: A single space between two solid characters. Both kinds of tokenizer start a
#: token there and never join what is left and right of it (``_cuts_hold``).
_CUT = re.compile(f"(?<=[^{_UNSAFE}]) (?=[^{_UNSAFE}])")
_SOLID = re.compile(f"[^{_UNSAFE}]")
JOINED = 1 << 16  # letters of pieces that are encoded as one text

_loaded: dict[bytes, "Tokenizers"] = {}


def _byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the
    others in order for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Tokenizer A (byte-level BPE, JSON) and B (SentencePiece model), with the
    bytes of every token."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = _byte_letters()
        entries = self.a.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            known = all(c in letters for c in entry)
            self.a_bytes[i] = bytes(letters[c] for c in entry) if known else entry.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i)
                                else piece.replace("▁", " ").encode())
        self.a_length = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        # Digits of every id with what may follow it in the digest.
        self.a_said = [np.array([f"{i}{s}" for i in range(len(self.a_bytes))], dtype=object) for s in ",|"]
        self.b_said = [np.array([f"{i}{s}" for i in range(len(self.b_bytes))], dtype=object) for s in ",;"]

        self.split = self._cuts_hold(json.loads(a_json))
        self.known: dict[str, tuple | None] = {}

    def _cuts_hold(self, a: dict) -> bool:
        """Whether texts may be encoded piece by piece: A splits by the byte-level
        pattern, which takes a space with the word after it, and no piece of B has
        a space after something else."""
        before = a.get("pre_tokenizer") or {}
        inner = re.compile("[^▁]▁")
        return (a.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", False)
                and not before.get("add_prefix_space", True)
                and not any(" " in t["content"] for t in a.get("added_tokens", []))
                and not any(inner.search(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())))

    @staticmethod
    def load(a_json: bytes, b_model: bytes) -> "Tokenizers":
        """One instance per worker process and pair of files."""
        key = hashlib.sha256(a_json + b_model).digest()
        if key not in _loaded:
            _loaded[key] = Tokenizers(a_json, b_model)
        return _loaded[key]

    def _pieces(self, text: str) -> list[str]:
        """Space + text, cut where no token can span; every piece starts with its space."""
        if not self.split:
            return [" " + text]
        first, *rest = _CUT.split(" " + text)
        return [first, *[" " + p for p in rest]]

    def _learn(self, group: list[str]) -> None:
        """Encode pieces, joined: no token spans the cut between two of them."""
        if not group:
            return
        text = "".join(group)
        spelled = text.encode()
        lengths = map(len, group if len(spelled) == len(text) else map(str.encode, group))
        ends = np.cumsum(np.fromiter(lengths, np.int64, len(group)))
        sides = []
        for ids, length, spell in (
                (self.a.encode(text, add_special_tokens=False).ids, self.a_length, self.a_bytes),
                (self.b.encode(text[1:]), self.b_length, self.b_bytes)):
            if b"".join([spell[t] for t in ids]) != spelled:
                break
            packed = np.array(ids, dtype=np.uint32)
            token_ends = np.cumsum(length[packed])
            at = np.full(len(spelled) + 1, -1, dtype=np.int32)
            at[token_ends] = np.arange(len(token_ends), dtype=np.int32)
            at = at[ends].astype(np.int64)
            if (at < 0).any():
                break
            # Bytes, not lists: the garbage collector does not visit them.
            raw, at = packed.tobytes(), 4 * (at + 1)
            sides.append([raw[x:y] for x, y in zip([0, *at[:-1].tolist()], at.tolist())])
        if len(sides) == 2:
            self.known.update(zip(group, zip(*sides)))
        elif len(group) == 1:
            self.known[group[0]] = None
        else:
            for p in group:
                self._learn([p])

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Ids of both sides, packed four bytes each. A text without bytes, or
        whose tokens do not spell a space and the text on both sides, has none.
        Each distinct piece of the texts is encoded once."""
        pieces = [self._pieces(t) if t else [] for t in texts]
        known = self.known
        fresh = set(chain.from_iterable(pieces)).difference(known)
        # Cuts have solid characters beside them; only a text's ends may not be solid.
        edges = {p for row in pieces if row for p in (row[0], row[-1])} & fresh
        alone = {p for p in edges if not (len(p) > 1 and _SOLID.match(p, 1) and _SOLID.match(p, len(p) - 1))}
        for p in alone:
            self._learn([p])
        group = list(fresh - alone)
        letters = np.cumsum(np.fromiter(map(len, group), np.int64, len(group))) // JOINED
        ends = np.flatnonzero(np.diff(letters)) + 1
        for first, last in zip([0, *ends.tolist()], [*ends.tolist(), len(group)]):
            self._learn(group[first:last])
        out = ([], [])
        for row in pieces:
            found = list(map(known.__getitem__, row))
            fits = bool(found) and all(found)  # what is known is None or a pair
            for side, ids in zip(out, zip(*found) if fits else ((), ())):
                side.append(b"".join(ids))
        if len(known) > CACHED_PIECES:
            known.clear()
        else:
            for p in fresh:
                if len(p) > CACHED_LENGTH:
                    del known[p]
        return out


def _tokens(ids: list[bytes], length: np.ndarray) -> pd.DataFrame:
    """Tokens of a batch in order: document, id, and byte range in the batch."""
    flat = np.frombuffer(b"".join(ids), dtype=np.uint32).astype(np.int64)
    end = np.cumsum(length[flat])
    return pd.DataFrame({
        "doc": np.repeat(np.arange(len(ids)), [len(row) // 4 for row in ids]),
        "id": flat, "start": end - length[flat], "end": end, "at": np.arange(len(flat))})


def overlapping(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of A, tokens of B) of all pairs whose byte ranges overlap.

    Of two overlapping tokens the later start lies in the other token, so the
    two directions find every pair; equal starts are found twice.
    """
    def covering(left, right):
        found = pd.merge_asof(
            left[["start", "doc", "at"]], right[["start", "doc", "at"]], on="start", by="doc",
            suffixes=("", "_other"))
        return found["at"].to_numpy(), found["at_other"].to_numpy().astype(np.int64)

    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a_of, b_of = covering(a, b)
    b_at, a_at = covering(b, a)
    new = a["start"].to_numpy()[a_at] != b["start"].to_numpy()[b_at]
    return np.concatenate([a_of, a_at[new]]), np.concatenate([b_of, b_at[new]])


def _group_strings(a: pd.DataFrame, b: pd.DataFrame, cuts: np.ndarray, said: Tokenizers, n_docs: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every document, '' without tokens."""
    a_end, b_end = a["end"].to_numpy(), b["end"].to_numpy()
    # Cuts at each byte and up to it.
    here = np.zeros(max(a_end.max(initial=0), b_end.max(initial=0)) + 1, dtype=np.int64)
    here[cuts] = 1
    upto = np.cumsum(here)
    a_last, b_last = here[a_end] > 0, here[b_end] > 0
    a_group, b_group = upto[a_end] - here[a_end], upto[b_end] - here[b_end]
    out = np.empty(len(a) + len(b), dtype=object)
    # Before a token stand its own side's earlier ones and the other side's of
    # earlier groups, for B of its own group too.
    until = [np.cumsum(np.bincount(group, minlength=len(cuts) + 1)) for group in (a_group, b_group)]
    b_before = np.concatenate([[0], until[1]])[a_group]
    a_before = until[0][b_group]
    ids = a["id"].to_numpy()
    out[np.arange(len(a)) + b_before] = np.where(a_last, said.a_said[1][ids], said.a_said[0][ids])
    ids = b["id"].to_numpy()
    out[np.arange(len(b)) + a_before] = np.where(b_last, said.b_said[1][ids], said.b_said[0][ids])
    sizes = (np.bincount(a["doc"], minlength=n_docs) + np.bincount(b["doc"], minlength=n_docs))
    ends = np.cumsum(sizes)
    return ["".join(out[e - s : e])[:-1] for s, e in zip(sizes, ends)]


def _lists(values: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


def _count(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, how often each stands)."""
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where.ravel(), times, len(found)).astype(np.int64)


def _align_batch(texts: list[str | None], tokenizers: Tokenizers):
    a_ids, b_ids = tokenizers.encode(texts)
    a, b = _tokens(a_ids, tokenizers.a_length), _tokens(b_ids, tokenizers.b_length)
    a_at, b_at = overlapping(a, b)
    a_end = a["end"].to_numpy()
    linked = a_end[a_at] == b["end"].to_numpy()[b_at]
    return a, b, a_at, b_at, linked


def overlaps(docs: DataFrame, a_json: bytes, b_model: bytes) -> DataFrame:
    """(doc_id, a_at, a_id, b_at, b_id, start, end, linked): every pair of
    overlapping tokens, ``at`` from 0 in their text and ``start`` to ``end`` the
    bytes they share in space + text. Texts without tokens have no rows."""
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in (
        "a_at", "a_id", "b_at", "b_id", "start", "end")], T.StructField("linked", T.BooleanType())])

    def emit(batches):
        tokenizers = Tokenizers.load(a_json, b_model)
        for whole in batches:
            for batch in kernel.chunks(whole, "text", BATCH_BYTES):
                a, b, a_at, b_at, linked = _align_batch(batch.column("text").to_pylist(), tokenizers)
                x, y = a.iloc[a_at].reset_index(drop=True), b.iloc[b_at].reset_index(drop=True)
                first = np.searchsorted(a["doc"], np.arange(len(batch)))
                first_b = np.searchsorted(b["doc"], np.arange(len(batch)))
                zero = np.append(a["start"].to_numpy(), 0)[first]
                doc = x["doc"].to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc)), *[pa.array(np.asarray(c, dtype=np.int64)) for c in (
                        a_at - first[doc], x["id"], b_at - first_b[doc], y["id"],
                        np.maximum(x["start"], y["start"]) - zero[doc],
                        np.minimum(x["end"], y["end"]) - zero[doc])], pa.array(linked)],
                    names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(emit, schema)


def align(docs: DataFrame, a_json: bytes, b_model: bytes) -> DataFrame:
    """A row for every document, and its links.

    Columns: ``block``, ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``groups`` (the groups'
    digest), and three arrays, a distinct linked id pair in each place: ``a``,
    ``b`` and ``times``. The last row of a block of documents also holds the
    block's pairs in ``block_a``, ``block_b`` and ``block_times``.

    A null or empty text, or one whose tokens do not spell it, has no tokens: zeros, an
    empty digest and empty arrays. Rows of one id are rows of their own, other
    columns are left out, an empty table gives an empty table. A text is
    encoded whole, in memory.
    """
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([
        T.StructField("block", T.LongType()), docs.schema["doc_id"],
        *[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups")],
        T.StructField("groups", T.StringType()),
        *[T.StructField(n, numbers) for n in ("a", "b")], T.StructField("times", T.ArrayType(T.LongType())),
        *[T.StructField(n, numbers) for n in ("block_a", "block_b")],
        T.StructField("block_times", T.ArrayType(T.LongType()))])

    def rows(batch, tokenizers, width):
        texts = batch.column("text").to_pylist()
        a, b, a_at, b_at, linked = _align_batch(texts, tokenizers)
        a_at, b_at = a_at[linked], b_at[linked]
        doc = a["doc"].to_numpy()[a_at]
        keys = a["id"].to_numpy()[a_at] * width + b["id"].to_numpy()[b_at]
        cuts = np.sort(a["end"].to_numpy()[a_at])
        said = _group_strings(a, b, cuts, tokenizers, len(texts))
        digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]
        order = np.lexsort((keys, doc))
        doc, keys = doc[order], keys[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])])[: len(doc)])
        times = np.diff(np.append(new, len(doc)))
        ends = np.cumsum(np.bincount(doc[new], minlength=len(texts)))
        count = lambda who: pa.array(np.bincount(who, minlength=len(texts)).astype(np.int64))
        columns = [batch.column("doc_id"), count(a["doc"]), count(b["doc"]), count(doc), pa.array(digests),
                   _lists(keys[new] // width, ends, pa.int32()), _lists(keys[new] % width, ends, pa.int32()),
                   _lists(times, ends, pa.int64())]
        return columns, keys[new], times

    def emit(batches):
        from pyspark import TaskContext

        tokenizers = Tokenizers.load(a_json, b_model)
        width = len(tokenizers.b_bytes)
        block, size = TaskContext.get().partitionId() << 32, 0
        held, keys, times = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(columns, last: bool):
            n = len(columns[0])
            own = [keys // width, keys % width, times]
            ends = [0] * n + [len(keys) if last else 0]
            missing = pa.array([not (last and i == n - 1) for i in range(n)])
            arrays = [pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(v if last else v[:0], k), mask=missing)
                for v, k in zip(own, (pa.int32(), pa.int32(), pa.int64()))]
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * n, pa.int64()), *columns, *arrays], names=schema.names)

        # A batch is held back until it is known whether it ends its block.
        for whole in batches:
            for batch in kernel.chunks(whole, "text", BATCH_BYTES):
                if not batch.num_rows:
                    continue
                if held is not None:
                    closed = size >= BLOCK_BYTES
                    yield out(held, closed)
                    if closed:
                        block, size = block + 1, 0
                        keys, times = keys[:0], times[:0]
                held, more, how_often = rows(batch, tokenizers, width)
                keys, times = _count(np.concatenate([keys, more]), np.concatenate([times, how_often]))
                size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if held is not None:
            yield out(held, True)

    return docs.select("doc_id", "text").mapInArrow(emit, schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links hold each id pair, and whether no A id
    is linked to that B id more often."""
    pairs = _block_pairs(aligned).groupBy("a", "b").agg(F.sum("times").alias("count"))
    highest = F.max("count").over(Window.partitionBy("b"))
    return pairs.withColumn("best", F.col("count") == highest)


def _block_pairs(aligned: DataFrame) -> DataFrame:
    zipped = F.arrays_zip(F.col("block_a").alias("a"), F.col("block_b").alias("b"), F.col("block_times").alias("times"))
    return aligned.where("block_a IS NOT NULL").select("block", F.inline(zipped))


def _link_sums(schema: T.StructType):
    def sums(docs: pa.Table, known: pa.Table) -> pa.Table:
        key = lambda a, b: np.asarray(a).astype(np.int64) << 32 | np.asarray(b).astype(np.int64)
        flat = lambda name: docs.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        have = key(known.column("a"), known.column("b"))
        order = np.argsort(have)
        at = order[np.searchsorted(have, key(flat("a"), flat("b")), sorter=order)] if len(have) else order
        times = flat("times")
        count, best = np.asarray(known.column("count")), np.asarray(known.column("best"))
        ends = np.cumsum(pc.list_value_length(docs.column("a")).to_numpy())
        per_doc = lambda v: np.diff(np.concatenate([[0], np.cumsum(v, dtype=np.int64)])[np.concatenate([[0], ends])])
        plain = [docs.column(f.name) for f in schema.fields[:-3]]
        return pa.table([*plain, pa.array(per_doc(times)), pa.array(per_doc(times * best[at])),
                         pa.array(per_doc(times * count[at]))], names=schema.names)
    return sums


def score_links(aligned: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, n_links, n_best, count_sum) of a
    table made by ``align`` and written: links, those whose pair is the most
    frequent of its B id, and the sum of the pairs' corpus counts."""
    plain = ["doc_id", "n_a", "n_b", "n_groups", "groups"]
    schema = T.StructType([*[aligned.schema[n] for n in plain], *[
        T.StructField(n, T.LongType()) for n in ("n_links", "n_best", "count_sum")]])
    pairs = _block_pairs(aligned).select(F.col("block").alias("asked"), "a", "b")
    known = pairs.join(link_counts(aligned), ["a", "b"]).select("asked", "a", "b", "count", "best")
    docs = aligned.select("block", *plain, "a", "b", "times")
    return docs.groupBy("block").cogroup(known.groupBy("asked")).applyInArrow(_link_sums(schema), schema)


def aligned_documents(docs: DataFrame, a_json: bytes, b_model: bytes) -> DataFrame:
    """``score_links`` of ``align``, encoded once."""
    return score_links(materialize(align(docs, a_json, b_model)))
