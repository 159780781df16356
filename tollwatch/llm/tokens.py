"""Token ids as flat binary files.

A folder holds, for each part, ``part-NNNNN.ids`` (unsigned little-endian
integers, 2 bytes each where the vocabulary allows, else 4), ``part-NNNNN.at``
(64-bit offsets of the part's documents, one more than documents) and
``part-NNNNN.docs`` (document ids), all to be memory-mapped, and one
``index.json`` with the prefix sums over the parts: how many documents and ids
come before each. The folder must be one that driver and executors mount, since
files are memory-mapped; a part is written under a name of its attempt and
renamed when whole, so a task that runs again leaves the same files.
"""

import functools
import itertools
import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import regex
from pyspark import TaskContext
from tokenizers import Tokenizer, pre_tokenizers

from tollwatch.session import fresh_path

#: Words and characters that a worker keeps with their ids, twice: those met since the last turn
#: and those of before. Beyond it the older ones go. Some 80 MB each at most, and let go of by
#: the tasks that read the files.
KEPT_WORDS = 3 << 17
KEPT_CHARS = 3 << 21
MET = 1 << 21
#: Words of characters before this one take the short way.
PLAIN_END = "\u0250"
# Fixed value: the split pattern of byte-level tokenizers.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
DOC = np.dtype([("doc_id", "<i8"), ("known", "u1")])
PARTS = "part long, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"

_CUT = re.compile(r"(?<=\S)(?= \S)")


def mounted(path):
    """Local form of a path that all machines mount."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file":
        return "/" + rest.lstrip("/")
    if colon and "/" not in scheme:
        raise ValueError(f"token files are memory-mapped; {path} is not a mounted folder")
    return path


class Words(dict):
    """Ids, as bytes, of words that follow a single space, found when first asked for.

    The value is None for what is no word: white space stands at an end of it.
    """

    def __init__(self, library, code):
        self.library, self.code, self.tokens = library, code, library.model.tokenize
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(ord(PLAIN_END))}
        self.parts, self.chars = {}, 0
        self.old, self.old_parts = {}, {}
        self.met = bytearray(MET)

    def held(self, piece):
        """Count a piece that is kept, and let the older ones go where there is no room."""
        if len(self) + len(self.parts) >= KEPT_WORDS or self.chars >= KEPT_CHARS:
            self.old, self.old_parts = dict(self), self.parts
            self.met = bytearray(MET)
            self.clear()
            self.parts, self.chars = {}, 0
        self.chars += len(piece)

    def known(self, word):
        """Whether the word, or one of its hash, has been met before; most are met only once."""
        place = hash(word) & (len(self.met) - 1)
        met, self.met[place] = self.met[place], 1
        return met

    def whole(self, piece):
        """Ids of a piece that the split pattern leaves whole."""
        ids = [t.id for t in self.tokens(piece.translate(self.letters))]
        return array(self.code, ids).tobytes()

    def part(self, piece):
        if piece[0] == " " and piece[1:].isalpha():
            return self[piece[1:]]
        found = self.parts.get(piece)
        if found is None:
            found = self.old_parts.get(piece) or self.whole(piece)
            self.held(piece)
            self.parts[piece] = found
        return found

    def __missing__(self, word):
        found = self.old[word] if word in self.old else self.ids(word)
        if word in self.old or self.known(word):
            self.held(word)
            self[word] = found
        return found

    def ids(self, word):
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        if not word.isascii() and max(word) >= PLAIN_END or "<|" in word:
            ids = self.library.encode(" " + word, add_special_tokens=False).ids
            return array(self.code, ids).tobytes()
        if word.isalpha():
            return self.whole(" " + word)
        if word[-1] in ".," and word[:-1].isalpha():
            return self[word[:-1]] + self.part(word[-1])
        return b"".join(map(self.part, SPLIT.findall(" " + word)))


class Encoder:
    """Ids of whole texts as bytes.

    A byte-level tokenizer with the usual split pattern never joins what stands
    on both sides of a single space, so the words between spaces are encoded
    by the library's model once each and looked up later. Other tokenizers get
    whole texts.
    """

    def __init__(self, tokenizer):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(tokenizer)
        setup = json.loads(self.library.to_str())
        self.splits = (setup["normalizer"] is None and setup["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False,
            "trim_offsets": setup["pre_tokenizer"].get("trim_offsets"), "use_regex": True}
            and all(t["content"].startswith("<|") for t in setup["added_tokens"]))
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.words = Words(self.library, "H" if self.dtype.itemsize == 2 else "I")

    def plain(self, texts):
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in encoded]

    def cut(self, text):
        """Ids of a text with other white space than single spaces between words."""
        head, *rest = _CUT.split(text)
        last = self.plain([rest.pop()]) if rest else []
        return b"".join([*self.plain([head]), *[self.words[r[1:]] for r in rest], *last])

    def encode(self, texts):
        if not self.splits:
            return self.plain(texts)
        words = [t.split(" ") for t in texts]
        heads = self.plain([w[0] for w in words])
        ids, out = self.words.__getitem__, []
        for text, head, own in zip(texts, heads, words, strict=True):
            own[0] = "" if len(own) > 1 and (not own[0] or own[0][-1].isspace()) else own[0]
            found = [head, *map(ids, own[1:])]
            out.append(self.cut(text) if len(own) > 1 and (not own[0] or None in found)
                       else b"".join(found))
        return out


@functools.lru_cache(2)
def encoder(tokenizer):
    return Encoder(tokenizer)


def _names(folder, part):
    return [f"{folder}/part-{part:05d}.{kind}" for kind in ("ids", "at", "docs")]


def _writer(folder, tokenizer, end_id):
    def write(batches):
        task, code = TaskContext.get(), encoder(tokenizer)
        part, end = task.partitionId(), np.array([end_id], code.dtype).tobytes()
        names = _names(folder, part)
        own = [f"{n}.{task.taskAttemptId()}" for n in names]
        at, known = 0, 0
        batches = iter(batches)
        batch = next(batches, None)
        if batch is None:
            return
        with open(own[0], "wb") as ids, open(own[1], "wb") as offsets, open(own[2], "wb") as docs:
            offsets.write(np.array([0], "<u8").tobytes())
            for batch in itertools.chain([batch], batches):
                for low in range(0, len(batch), 256):
                    piece = batch.slice(low, 256)
                    texts = ["" if t is None else t for t in piece.column(1).to_pylist()]
                    encoded = code.encode(texts)
                    for e in encoded:
                        ids.write(e)
                        ids.write(end)
                    ends = at + np.cumsum([len(e) // code.dtype.itemsize + 1 for e in encoded])
                    offsets.write(ends.astype("<u8").tobytes())
                    row = np.zeros(len(piece), DOC)
                    keys = piece.column(0)
                    row["known"] = keys.is_valid().to_numpy(zero_copy_only=False)
                    row["doc_id"] = keys.fill_null(0).to_numpy(zero_copy_only=False)
                    docs.write(row.tobytes())
                    at, known = int(ends[-1]), known + len(piece)
        for temporary, name in zip(own, names, strict=True):
            os.replace(temporary, name)
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [known], "n_ids": [at]})

    return write


def write_tokens(docs, tokenizer, path=None, end_id=2, doc_id="doc_id", text="text"):
    """Encode every text, add ``end_id``, write the files in order of ``doc_id``.

    Returns the folder. Rows with one id follow each other in the order of a
    hash of their text; rows without an id come first; a null text is empty; an
    empty table makes an index without parts. Other columns are not looked at.
    Only one row of counts per part comes to the driver.
    """
    spark = docs.sparkSession
    folder = mounted(path or fresh_path(spark, "tokens"))
    os.makedirs(folder, exist_ok=True)
    order = [F.asc_nulls_first("id"), F.asc("h"), F.asc("r")]
    parts = (
        docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
        .withColumns({"h": F.xxhash64("t"), "r": F.monotonically_increasing_id()})
        .repartitionByRange(*order).sortWithinPartitions(*order).select("id", "t")
        .mapInArrow(_writer(folder, tokenizer, end_id), PARTS).collect()
    )
    parts = sorted(parts, key=lambda p: p.part)
    docs_before = [0, *itertools.accumulate(p.n_docs for p in parts)]
    ids_before = [0, *itertools.accumulate(p.n_ids for p in parts)]
    index = {
        "dtype": encoder(tokenizer).dtype.str, "end_id": end_id,
        "n_docs": docs_before[-1], "n_ids": ids_before[-1],
        "parts": [{"part": p.part, "first_doc": d, "first_id": i}
                  for p, d, i in zip(parts, docs_before, ids_before)],
    }
    with open(f"{folder}/index.json.new", "w") as out:
        json.dump(index, out)
    os.replace(f"{folder}/index.json.new", f"{folder}/index.json")
    return folder


def open_part(folder, part, dtype):
    """Memory maps of the ids, offsets and document ids of a part."""
    ids, at, docs = _names(folder, part)
    return (np.memmap(ids, dtype, "r"), np.memmap(at, "<u8", "r"), np.memmap(docs, DOC, "r"))


def read_tokens(spark, path):
    """One row per document of a token folder: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before; the checksum is over the
    ids as little-endian unsigned 32-bit integers.
    """
    folder = mounted(path)
    with open(f"{folder}/index.json") as f:
        index = json.load(f)
    parts = index["parts"]
    dtype = index["dtype"]

    def read(batches):
        encoder.cache_clear()  # workers that wrote before hold words no longer needed
        for batch in batches:
            for part, base in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                ids, at, docs = open_part(folder, part, dtype)
                at = at.astype(np.int64)
                for low in range(0, len(docs), 4096):
                    own = docs[low:low + 4096]
                    edges = at[low:low + len(own) + 1]
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes())
                            for a, b in itertools.pairwise(edges.tolist())]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(own["doc_id"].astype(np.int64), pa.int64(),
                                           mask=own["known"] == 0),
                        "start": base + edges[:-1], "n_tokens": np.diff(edges),
                        "ids_crc32": pa.array(sums, pa.int64())})

    listed = spark.createDataFrame([(p["part"], p["first_id"]) for p in parts],
                                   "part long, first_id long")
    return listed.repartition(max(1, len(parts))).mapInArrow(read, ROWS)
