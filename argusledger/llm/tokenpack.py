"""Token-ID output: ids bit-packed at a fixed width, with block offsets for random access.

A pack is a self-contained byte string (see :func:`pack`): a header, the documents' ids and starts, block offsets, and
blocks of ``BLOCK`` ids, each id in the fewest bits that hold the vocabulary, lowest bit first, each block on a byte
boundary.  numpy unpacks a block, a document or all ids without a loop over ids.

Each pack is a file, written by an executor straight to the shared folder (any store that pyarrow opens: a mounted folder,
HDFS, S3, GCS).  A task's files bear its attempt's name, and only files that a finished attempt has listed in the manifest, a
Parquet table (part, seq, n_ids, n_docs, n_null, file), belong to the output: so lost executors and repeated attempts leave stray
files at worst.  Documents are in ascending doc_id order (null first; rows that share an id by a hash of the text, equal
rows in any order), so rows without id are many tasks too.

Edge cases: null and empty texts have the end id only; a text of any length is one document, in a file of its own if it is
long; an empty table gives no files.  Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argusledger.llm.common import chunks, partitions, process_cache, release, shared_dir, small

MAGIC, BLOCK, PACK_IDS = b"ATPK", 4096, 1 << 20
_HEAD = "<4sIIIQQ"
#: Words that a worker keeps the ids of: in a task, and after it.
CACHE, KEEP = 500_000, 100_000


# --- the format ------------------------------------------------------------------------------


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def _squeeze(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    places = (ids[:, None].astype(np.uint64) >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(places.astype(np.uint8).ravel(), bitorder="little").tobytes()


def _expand(raw, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count).astype(np.uint32)
    places = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (places.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def pack(ids: np.ndarray, starts: np.ndarray, doc_ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """Header (magic, version, bits, block, ids, documents), doc ids, starts (one more), block offsets (one more), blocks."""
    body = [_squeeze(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in body])]).astype("<u8")
    return b"".join([struct.pack(_HEAD, MAGIC, 1, bits, block, len(ids), len(doc_ids)), doc_ids.astype("<i8").tobytes(), starts.astype("<u8").tobytes(), offsets.tobytes(), *body])


class Pack:
    """A view of a pack's bytes (bytes, memoryview or memmap)."""

    def __init__(self, raw):
        magic, version, self.bits, self.block, self.size, docs = struct.unpack_from(_HEAD, raw, 0)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token pack")
        at = struct.calcsize(_HEAD)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.starts = np.frombuffer(raw, "<u8", docs + 1, at + 8 * docs).astype(np.int64)
        at += 8 * (2 * docs + 1)
        blocks = -(-self.size // self.block)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, at).astype(np.int64)
        self.raw, self.base = memoryview(raw), at + 8 * (blocks + 1)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from start to stop: just the blocks that hold them are unpacked."""
        stop = self.size if stop is None else min(stop, self.size)
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        raw = self.raw[self.base + self.offsets[first] : self.base + self.offsets[last + 1]]
        if (self.block * self.bits) % 8 == 0:
            count = min(self.size, (last + 1) * self.block) - first * self.block
            out = _expand(raw, self.bits, count)
        else:
            sizes = [min(self.size, (b + 1) * self.block) - b * self.block for b in range(first, last + 1)]
            out = np.concatenate([_expand(self.raw[self.base + self.offsets[b] : self.base + self.offsets[b + 1]], self.bits, n) for b, n in zip(range(first, last + 1), sizes, strict=True)])
        return out[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


# --- encoding --------------------------------------------------------------------------------


def _alphabet() -> dict[int, int]:
    """Byte-level BPE's character for each byte: itself if it prints, else the next from U+0100 on.  Byte 0, which no plain
    text has, becomes the space that parts pieces."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)).difference(shown))
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)} | {0: 0x20}


class Encoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library.

    Its pre-tokenizer cuts a text into pieces, each of which is encoded for itself, and always cuts before a space that
    a character follows.  So a batch's words, with the space before them, are looked up, and those not known are cut
    into pieces that go to the library's model as one string; byte lengths of its ids tell where a word's ids end.  The
    first words that a worker meets, the frequent ones, are kept.  Texts with characters on which the two pattern
    engines could differ, or with a special token's string, go to the library whole.
    """

    def __init__(self, spec: str):
        import json
        import re

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library = Tokenizer.from_str(spec)
        plan = json.loads(spec)
        split, model = plan.get("pre_tokenizer") or {}, plan["model"]
        self.special = [t["content"] for t in plan.get("added_tokens", [])]
        self.alphabet = _alphabet()
        vocabulary = model["vocab"] if model.get("type") == "BPE" else {}
        known = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and plan.get("normalizer") is None
        known = known and all(chr(c) in vocabulary for b, c in self.alphabet.items() if b) and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        # Plain: printable ASCII, tab, newline, Latin letters and marks but no fractions or superscripts, general punctuation.
        self.plain = re.compile(r"[\t\n\r\x20-\x7E\u00A1-\u00B1\u00B4-\u00B8\u00BA\u00BB\u00BF-\u024F\u2010-\u2027\u2030-\u205E]*") if known else None
        self.pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
        self.loose = re.compile(r" (?=\s|\Z)")
        self.words: dict[str, bytes] = {}
        if known:
            self.model = Tokenizer(self.library.model)
            self.model.pre_tokenizer = CharDelimiterSplit(" ")
            self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.lengths[i] = len(token)  # a character a byte

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_model(self, pieces: list[str], sizes: list[int]) -> list[bytes]:
        """Ids of strings of ``sizes`` bytes, whose pieces follow each other."""
        if not pieces:
            return [b""] * len(sizes)
        text = "\0".join(pieces).encode().decode("latin-1").translate(self.alphabet)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(self.lengths[ids])
        to = 4 * (np.searchsorted(ends, np.cumsum(sizes), "left") + 1)
        raw, to = ids.tobytes(), [0, *to.tolist()]
        return [raw[a:b] for a, b in zip(to, to[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = [b""] * len(texts)
        whole, starts, spaced = [], [], []
        new: dict[str, None] = {}
        for i, text in enumerate(texts):
            if text and (self.plain is None or not self.plain.fullmatch(text) or any(x in text for x in self.special)):
                whole.append(i)
            elif text and (text[0] == " " or self.loose.search(text)):
                starts.append((i, text))
            elif text:
                first, _, rest = text.partition(" ")
                starts.append((i, first))
                if rest:
                    words = rest.split(" ")
                    found = list(map(self.words.get, words))
                    gaps = [k for k, x in enumerate(found) if x is None]
                    new.update((words[k], None) for k in gaps)
                    spaced.append((i, words, found, gaps))
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids
        pieces = self.pieces.findall(" " + " ".join(new)) if new else []
        for _, x in starts:
            pieces += self.pieces.findall(x)
        ids = self._by_model(pieces, [len(x.encode()) + 1 for x in new] + [len(x.encode()) for _, x in starts])
        self.words.update(zip(new, ids[: len(new)], strict=True))
        for (i, _), x in zip(starts, ids[len(new) :], strict=True):
            out[i] = x
        for i, words, found, gaps in spaced:
            for k in gaps:
                found[k] = self.words[words[k]]
            out[i] += b"".join(found)
        self.words = _trim(self.words)
        return out

    def settle(self) -> None:
        """Between tasks just the most frequent (the first met) stay."""
        self.words = _trim(self.words, KEEP, KEEP)


def _trim(kept: dict[str, bytes], most: int = CACHE, to: int = CACHE // 4) -> dict[str, bytes]:
    return kept if len(kept) <= most else dict(islice(kept.items(), to))


def _encoder(spec: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    cache = process_cache("encoders")
    key = (len(spec), zlib.crc32(spec.encode()))
    if key not in cache:
        cache[key] = Encoder(spec)
    return cache[key]


def _open(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


_MANIFEST = "part long, seq long, n_ids long, n_docs long, n_null long, file string"


def _encode(shared, bits: int, end: int, folder: str):
    def run(batches):
        coder = _encoder(shared.value)
        stop = np.array([end], "<u4").tobytes()
        task = TaskContext.get()
        part, seq = task.partitionId(), 0
        store, root = _open(folder)
        store.create_dir(root)

        def flush():
            flat = np.frombuffer(b"".join(ids), "<u4")
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
            name = f"part-{part:06d}-{seq:05d}-{task.taskAttemptId()}.atpk"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(pack(flat, starts, np.array([x or 0 for x in own], np.int64), bits))
            # Null doc_ids come first in the order.
            values = (part, seq, len(flat), len(own), sum(x is None for x in own), name)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in values], names=["part", "seq", "n_ids", "n_docs", "n_null", "file"])

        ids, own, size = [], [], 0
        for batch in batches:
            for some in chunks(batch, "text"):
                for doc, x in zip(some.column("doc_id").to_pylist(), coder.encode(some.column("text").to_pylist()), strict=True):
                    ids.append(x + stop)
                    own.append(doc)
                    size += len(x) // 4 + 1
                    if size >= PACK_IDS:
                        yield flush()
                        ids, own, size, seq = [], [], 0, seq + 1
        if own:
            yield flush()
        ids, own = [], []
        coder.settle()
        release(keep="encoders")

    return run


def write_packs(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes ``docs`` (doc_id, text) as pack files to the folder ``path``, or one in the shared folder; returns the manifest.

    The manifest is written beside the files (``path``/manifest), and has each file's full name.  ``tokenizer`` is the path of
    a tokenizers file; its content is broadcast (a few MB, whatever the input).
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    bits = width(max(Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True), end_id + 1))
    path = path or f"{shared_dir(spark)}/argus-packs-{uuid.uuid4().hex}"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    # The row's number deals out equal rows, of which a hot id can have very many.
    dealt = own.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), "h", "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    made = dealt.select("doc_id", "text").mapInArrow(_encode(spark.sparkContext.broadcast(spec), bits, end_id, path), _MANIFEST)
    made.write.parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark, path: str) -> DataFrame:
    """The manifest of a folder of packs, with each file's path."""
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").withColumn("file", F.concat(F.lit(f"{path}/"), "file"))


def open_pack(path: str) -> Pack:
    """A pack file; on a mounted folder it is mapped, so that just what is asked for is read."""
    store, name = _open(path)
    try:
        with store.open_input_file(name) as f:
            return Pack(f.read_buffer())
    except OSError as e:
        raise FileNotFoundError(f"token pack {path}: {e}") from e


def _list(batches):
    for batch in batches:
        for row in batch.to_pylist():
            p = open_pack(row["file"])
            n, sums = np.diff(p.starts), [0] * len(p.doc_ids)
            for at in range(0, p.size, PACK_IDS):  # so that one long document is not unpacked at once
                flat = memoryview(p.ids(at, at + PACK_IDS).astype("<u4"))
                some = range(int(np.searchsorted(p.starts, at, "right")) - 1, int(np.searchsorted(p.starts, at + len(flat), "left")))
                for d, lo, hi in zip(some, p.starts[some.start : some.stop].tolist(), p.starts[some.start + 1 : some.stop + 1].tolist(), strict=True):
                    sums[d] = zlib.crc32(flat[max(0, lo - at) : hi - at], sums[d])
            doc = [None if i < row["n_null"] else x for i, x in enumerate(p.doc_ids.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row["base"] + p.starts[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
            del p
    release()


def read_documents(packs: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of a manifest.  Starts come from the files' sizes: the driver sees one
    sum for each partition that wrote files."""
    spark = packs.sparkSession
    sums = sorted((r.part, r.n) for r in packs.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, at = [], 0
    for part, n in sums:
        bases.append((part, at))
        at += n
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = packs.withColumn("before", before).join(small(spark.createDataFrame(bases, "part long, at long")), "part")
    whole = places.select((F.col("at") + F.col("before")).alias("base"), "n_null", "file")
    # One file a row: they are dealt out evenly.
    return whole.repartition(partitions(spark), "file").mapInArrow(_list, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return read_documents(write_packs(docs, tokenizer))
