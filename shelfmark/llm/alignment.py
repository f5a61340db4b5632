"""Alignment of two tokenizers' tokens by whitespace-token anchors.

Each text is tokenized whole by both: a blank and the text by a byte-level vocabulary (A), the text by a piece model (B,
which adds the blank itself). Token lengths in bytes give each token's end. An anchor is an end that both have and after
which both go on with a token marked by a blank; anchors cut a document into windows of token ids. Words come back again
and again, so a worker remembers the alignment of a window by its two tuples of ids.

In a window, ends that both have close a group, and two tokens are linked if their byte ranges overlap. How often a pair
of ids is linked is counted over all documents. Each task adds up its pairs before they are shuffled. For the way back,
from counts to documents, the most common pairs travel to the documents (at most ``COMMON`` of them, a fixed bound), and
all others are joined; so no frequent pair is a hot key, and none is left out.

Texts that are null, empty or not given back byte by byte by both tokenizers have no tokens: zeros, and an empty digest.
Long texts are taken whole; a text without anchors is one window. Repeated rows and ids are documents of their own. An
empty table gives no rows. Columns other than ``doc_id`` and ``text`` are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import kept, list_array, map_columns, texts_of, written

#: Most pairs that travel to all tasks (20 bytes each).
COMMON = 1 << 17
#: Characters and texts of a batch; windows and bytes of links that a worker remembers. They change speed, never results.
BATCH_CHARS, BATCH_TEXTS = 2_000_000, 1_000
WINDOWS, WINDOW_BYTES = 400_000, 32_000_000
_BITS = 16
_MARK = (1 << _BITS) - 1


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_vocabulary(path: str) -> dict[bytes, int]:
    """Bytes and id of each ordinary token of a byte-level merge model whose ids are in the order of its merges."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"] for t in model.get("added_tokens", [])}
    letters = byte_letters()
    vocab = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    ids = [model["model"]["vocab"]["".join(m)] for m in pairs]
    if model.get("normalizer") or any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
        raise ValueError("only byte-level merges without a normalizer, with ids in their order, are supported")
    return vocab


class Aligner:
    """Both tokenizers, and the windows met so far."""

    def __init__(self, byte_path: str, piece_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        vocab = byte_vocabulary(byte_path)
        self.a = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for data, i in vocab.items():
            self.a_bytes[i] = data
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        if max(len(self.a_bytes), len(self.b_bytes)) >= 1 << _BITS:
            raise ValueError("vocabularies of 65,536 ids or more are not supported")
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_blank, self.b_blank = (np.array([x[:1] == b" " for x in t]) for t in (self.a_bytes, self.b_bytes))
        # Ids as text with the sign behind: in a group, behind its last id of A, and the same for B.
        self.signed = [f"{i}{sign}" for sign in ",|,;" for i in range(1 << _BITS)]
        self.signed_size = np.array([len(x) for x in self.signed])
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.groups: list[str] = []
        self.pairs: list[bytes] = []
        self.held = 0

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or None if there are none or one of them does not spell the text."""
        if not text:
            return None
        whole = " " + text
        data = whole.encode()
        a, b = self.a.encode_ordinary(whole), self.b.encode(text)
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return np.array(a, np.uint16), np.array(b, np.uint16)

    def windows(self, a: np.ndarray, b: np.ndarray) -> tuple[list[bytes], int]:
        """A text's windows, each as its ids of A, a mark and its ids of B, and how many groups the text has."""
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        mark = np.zeros(a_end[-1] + 1, np.int8)
        mark[a_end] = 1
        mark[b_end] += 2
        at_a, at_b = np.flatnonzero(mark[a_end] == 3) + 1, np.flatnonzero(mark[b_end] == 3) + 1
        ahead = np.append(self.a_blank[a[at_a[:-1]]] & self.b_blank[b[at_b[:-1]]], True)
        place_a, place_b, cuts = _woven(at_a[ahead], at_b[ahead], 1)
        woven = np.full(cuts[-1], _MARK, np.uint16)
        woven[place_a], woven[place_b] = a, b
        data, cuts = woven.tobytes(), (2 * cuts).tolist()
        return [data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)], len(at_a)

    def align(self, windows: list[bytes]) -> None:
        """Remember new windows: their groups as text, and a pair of ids for each link. All are worked out side by side.

        Up to each end of a token, one token of A and one of B are linked.
        """
        woven = np.frombuffer(b"".join(windows), np.uint16)
        ends = np.cumsum([len(w) // 2 for w in windows])
        marks = np.flatnonzero(woven == _MARK)
        size = np.diff(ends, prepend=0)
        is_a = np.arange(len(woven)) < np.repeat(marks, size)
        is_b = np.arange(len(woven)) > np.repeat(marks, size)
        a, b = woven[is_a], woven[is_b]
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        mark = np.zeros(a_end[-1] + 1, np.int8)
        mark[a_end] = 1
        mark[b_end] += 2
        at_a, at_b = np.flatnonzero(mark[a_end] == 3) + 1, np.flatnonzero(mark[b_end] == 3) + 1
        # The last group of each window.
        last = np.searchsorted(at_a, np.cumsum(marks - (ends - size)))
        spots = np.flatnonzero(mark)
        ends_a, ends_b = mark[spots] & 1, mark[spots] >> 1
        links = a[np.cumsum(ends_a) - ends_a].astype(np.uint32) << _BITS | b[np.cumsum(ends_b) - ends_b]
        cuts = np.concatenate([[0], 4 * (np.flatnonzero(mark[spots] == 3) + 1)[last]]).tolist()
        data = links.tobytes()
        # The text of all groups: each id with the sign that follows it.
        place_a, place_b, seams = _woven(at_a, at_b, 0)
        kind_a, kind_b = np.zeros(len(a), np.int64), np.full(len(b), 2)
        kind_a[at_a - 1], kind_b[at_b - 1] = 1, 3
        signed = np.zeros(seams[-1], np.int64)
        signed[place_a], signed[place_b] = a + (kind_a << _BITS), b + (kind_b << _BITS)
        text = "".join(map(self.signed.__getitem__, signed.tolist()))
        far = np.concatenate([[0], np.cumsum(self.signed_size[signed])])[seams[np.append(0, last + 1)]].tolist()
        made = len(self.groups)
        self.known.update(zip(windows, range(made, made + len(windows)), strict=True))
        self.groups += [text[i:j] for i, j in zip(far, far[1:], strict=False)]
        self.pairs += [data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        self.held += len(data)


def _woven(ends_a: np.ndarray, ends_b: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of two sequences cut into runs, so that each run of the first is followed by ``gap`` places and the run of the
    second, and where each such pair of runs starts and ends."""
    many_a, many_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    run = np.arange(len(ends_a)) * gap
    place_a = np.arange(ends_a[-1]) + np.repeat(ends_b - many_b + run, many_a)
    place_b = np.arange(ends_b[-1]) + np.repeat(ends_a + run + gap, many_b)
    return place_a, place_b, np.concatenate([[0], ends_a + ends_b + run + gap])


def aligner(byte_path: str, piece_path: str) -> Aligner:
    return kept(("aligner", byte_path, piece_path), lambda: Aligner(byte_path, piece_path))


def aligned(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """A row per document: ``doc_id``, sizes, the digest of its groups, and its pairs with their number of links.

    Rows without ``groups_sha256`` are the tasks' sums of pairs. Pairs are ``a << 16 | b``.
    """
    paths = default_paths()
    paths = byte_path or paths[0], piece_path or paths[1]

    def batch(coder: Aligner, ids: list, texts: list[str]) -> tuple:
        if len(coder.groups) > WINDOWS or coder.held > WINDOW_BYTES:
            coder.forget()
        n_a, n_b, n_groups, used = [], [], [], []
        for text in texts:
            found = coder.tokens(text)
            windows, groups = coder.windows(*found) if found else ([], 0)
            used.append(windows)
            n_a.append(len(found[0]) if found else 0)
            n_b.append(len(found[1]) if found else 0)
            n_groups.append(groups)
        new = set().union(*used).difference(coder.known)
        if new:
            coder.align(list(new))
        pairs, counts, n_links, digests = [], [], [], []
        for windows in used:
            numbers = list(map(coder.known.__getitem__, windows))
            text = "".join(map(coder.groups.__getitem__, numbers))
            digests.append(hashlib.sha256(text[:-1].encode()).hexdigest() if text else "")
            links = np.frombuffer(b"".join(map(coder.pairs.__getitem__, numbers)), np.uint32)
            keys, times = np.unique(links, return_counts=True)
            n_links.append(len(links))
            pairs.append(keys.astype(np.int64))
            counts.append(times)
        # The sum of the batch is one more row, without a document.
        every, where = np.unique(np.concatenate(pairs), return_inverse=True)
        sums = np.bincount(where, np.concatenate(counts), len(every)).astype(np.int64)
        pairs.append(every)
        counts.append(sums)
        return ([*ids, None], [*n_a, None], [*n_b, None], [*n_groups, None], [*n_links, None], [*digests, None],
                list_array(pairs, pa.int64()), list_array(counts, pa.int64()))

    def work(batches: Iterator[list[pa.Array]]) -> Iterator[tuple]:
        coder = aligner(*paths)
        ids, texts, size = [], [], 0
        for doc_ids, column in batches:
            for doc_id, text in zip(doc_ids.to_pylist(), texts_of(column), strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= BATCH_CHARS or len(texts) >= BATCH_TEXTS:
                    yield batch(coder, ids, texts)
                    ids, texts, size = [], [], 0
        if texts:
            yield batch(coder, ids, texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_columns(
        docs.select("doc_id", "text"), work,
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<long>, counts array<long>")


def pair_counts(parts: DataFrame) -> DataFrame:
    """``pair``, its ``count`` over all documents, and whether it is the ``best`` of its B id, ties included."""
    spots = parts.where("groups_sha256 IS NULL").select(F.inline(F.arrays_zip("pairs", "counts")))
    sums = written(spots.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("count")))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << _BITS) - 1))
    highest = sums.groupBy(b_id.alias("b")).agg(F.max("count").alias("highest"))
    return sums.withColumn("b", b_id).join(highest, "b").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_tokens(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: how its tokens of both vocabularies match.

    ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair of ids is linked as often as any
    pair with that B id), ``count_sum`` (over links, how often their pair is linked) and ``groups_sha256``.
    """
    parts = written(
        aligned(docs, byte_path, piece_path).withColumn("tag", F.monotonically_increasing_id()), compression="zstd")
    counted = written(pair_counts(parts))
    most = counted.orderBy(F.desc("count"), "pair").limit(COMMON).toArrow()
    order = np.argsort(most["pair"].to_numpy())
    names, counts, best = (most[c].to_numpy()[order] for c in ("pair", "count", "best"))

    def look_up(pairs: pa.ListArray, times: pa.ListArray) -> tuple:
        ends = pairs.offsets.to_numpy()
        flat, n = pairs.values.to_numpy()[ends[0]:ends[-1]], times.values.to_numpy()
        n = n[times.offsets.to_numpy()[0]:][:len(flat)]
        ends = ends - ends[0]
        at = np.minimum(np.searchsorted(names, flat), max(0, len(names) - 1))
        hit = names[at] == flat if len(names) else np.zeros(len(flat), bool)

        def summed(values: np.ndarray) -> np.ndarray:
            before = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
            return before[ends[1:]] - before[ends[:-1]]

        known = np.where(hit, at, 0)
        share = np.where(hit, n, 0)
        left = np.concatenate([[0], np.cumsum(~hit)])[ends].astype(np.int32)
        rest = (pa.ListArray.from_arrays(pa.array(left), pa.array(x[~hit], pa.int64())) for x in (flat, n))
        if not len(names):
            return (np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64), *rest)
        return summed(share * best[known]), summed(share * counts[known]), *rest

    sizes = ["tag", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = written(map_columns(
        parts.where("groups_sha256 IS NOT NULL").select(*sizes, "pairs", "counts"), look_up,
        "best_here long, sum_here long, rest array<long>, times array<long>", carry=sizes))
    others = rows.select("tag", F.inline(F.arrays_zip("rest", "times"))).withColumnRenamed("rest", "pair")
    more = others.join(counted, "pair").groupBy("tag").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_more"),
        F.sum(F.col("times") * F.col("count")).alias("sum_more"))
    return rows.drop("rest", "times").join(more, "tag", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("best_here") + F.coalesce("best_more", F.lit(0))).alias("n_best"),
        (F.col("sum_here") + F.coalesce("sum_more", F.lit(0))).alias("count_sum"), "groups_sha256")
