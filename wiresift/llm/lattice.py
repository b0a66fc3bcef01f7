"""SentencePiece encoding and decoding as joins and a fold (operator 10).

Words are made distinct: runs of one kind of character (letters, digits, others) with the word marks before them, cut only where no piece of the
vocabulary reaches across, so that a text's best path is those of its words in a row. Blocks of documents keep their words as numbers and deal the distinct ones by a hash, so that equal words of many blocks
meet in one task. There the substrings of a batch of words are joined with the piece table, character by character, and end where no piece goes on; the matches are the edges of the
words' lattices, and a fold over them, in order of their starts and of all words at once, keeps the best path to each position (Viterbi): highest sum of scores, of equal ones the
path whose last piece starts first. Characters without a piece become byte pieces at a penalty below every score. The ids go back to the blocks, where texts are put together from them
and decoded from their whole id sequences.
"""
from __future__ import annotations

import ctypes
import hashlib
import unicodedata
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wiresift.llm import scan
from wiresift.llm.common import small_batches

MARK = "▁"
#: Longer words would hold up the fold of all words of a batch; they take the same dynamic program a word at a time.
LONG = 200
PENALTY = 10.0
#: Bytes of text in a block of documents, and its rows at most.
BLOCK, ROWS = 16 << 20, 1 << 16
#: The distinct words of a block are dealt to so many tasks, with those of other blocks: of `NEAR` neighbouring input partitions, and so many blocks of each.
BUCKETS, NEAR = 32, 32
#: Words of a batch that are made distinct together, and their bytes; characters whose lattices are folded at once.
WORDS, WORD_BYTES, FOLDED = 1 << 20, 8 << 20, 1 << 17
#: Bytes of text that are split at once, and words of a longer stretch without spaces.
STRETCH, TOKENS = 1 << 20, 1 << 17
#: Zstandard's level for what is moved between tasks.
LEVEL = 4
#: Words or ids that are put together or decoded at once.
IDS = 1 << 17


class Vocabulary:
    """Pieces of a SentencePiece model file: (piece, id, score) of the normal ones, the id of byte 0, the penalty score of unknown characters."""

    def __init__(self, model: str):
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=model)
        n = m.vocab_size()
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.rows = [(m.id_to_piece(i), i, float(m.get_score(i))) for i in plain]
        bytes_ = [i for i in range(n) if m.is_byte(i)]
        if len(bytes_) != 256 or bytes_ != list(range(bytes_[0], bytes_[0] + 256)):
            raise ValueError("the model must have 256 byte pieces in a row")
        self.byte0, self.longest = bytes_[0], max(len(p) for p, _, _ in self.rows)
        self.unknown = min(s for _, _, s in self.rows) - PENALTY
        self.pattern = self._pattern()

    def _pattern(self) -> str:
        """What a word is: kinds of characters that some piece joins count as one kind."""
        def kind(c):
            return "M" if c == MARK else {"L": "L", "M": "L", "N": "N"}.get(unicodedata.category(c)[0], "O")
        joined = {(kind(a), kind(b)) for p, _, _ in self.rows for a, b in zip(p, p[1:])}
        if any(b == "M" and a != "M" for a, b in joined):
            raise ValueError("a piece holds a word mark behind another character")
        group = {k: k for k in "LNO"}
        for a, b in joined:
            if a != "M" and group[a] != group[b]:
                group = {k: group[a] if g == group[b] else g for k, g in group.items()}
        has = {"L": r"\p{L}\p{M}", "N": r"\p{N}"}
        runs = []
        for g in sorted(set(group.values())):
            inside = [k for k in "LNO" if group[k] == g]
            if "O" in inside:  # all that the other runs do not take
                runs.append(f"[^{MARK}{''.join(has[k] for k in has if k not in inside)}]+")
            else:
                runs.append(f"[{''.join(has[k] for k in inside)}]+")
        return "(" + "|".join([*(f"{MARK}*{r}" for r in runs), f"{MARK}+"]) + ")"

    def lattice(self) -> Lattice:
        return Lattice(self)


class Lattice:
    """The piece table as numpy arrays: every prefix of a piece has a number, and a sorted key of (prefix, next character) leads to the longer one."""

    def __init__(self, vocabulary: Vocabulary):
        nodes = {"": 0}
        for piece, _, _ in vocabulary.rows:
            for k in range(1, len(piece) + 1):
                nodes.setdefault(piece[:k], len(nodes))
        letters = sorted({c for piece, _, _ in vocabulary.rows for c in piece})
        self.kinds = np.zeros(ord(letters[-1]) + 2, np.int32)  # 0: in no piece, as are all characters past the last
        self.kinds[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        keys = np.array([nodes[x[:-1]] * self.width + self.kinds[ord(x[-1])] for x in nodes if x], np.int64)
        order = np.argsort(keys)
        self.keys, self.longer = keys[order], (order + 1).astype(np.int32)
        self.first = np.full(self.width, -1, np.int32)
        self.first[self.keys[self.keys < self.width]] = self.longer[self.keys < self.width]
        self.id, self.score = np.full(len(nodes), -1, np.int32), np.zeros(len(nodes))
        for piece, i, score in vocabulary.rows:
            self.id[nodes[piece]], self.score[nodes[piece]] = i, score
        self.byte0, self.unknown = vocabulary.byte0, vocabulary.unknown

    def edges(self, chars: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id, score) of all pieces in words; `end`: where the word of each character ends. A character that is no piece is an edge with the id -1."""
        kinds = self.kinds[np.minimum(chars, len(self.kinds) - 1)]
        at, node, found = np.arange(len(chars)), self.first[kinds], []
        own = np.where(node >= 0, self.id[node], -1)
        found.append((at, np.ones(len(at), np.int64), own, np.where(own >= 0, self.score[node], self.unknown)))
        at, node, n = at[node >= 0], node[node >= 0], 1
        while len(at):
            inside = at + n < end[at]
            at, node = at[inside], node[inside]
            key = node * np.int64(self.width) + kinds[at + n]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[place] == key
            at, node, n = at[known], self.longer[place[known]], n + 1
            whole = self.id[node] >= 0
            found.append((at[whole], np.full(whole.sum(), n), self.id[node[whole]], self.score[node[whole]]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def ids(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the best paths of words, one after another; how many each has), from their joined UTF-8 bytes and numbers of characters, none of them 0."""
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.cumsum(length) - length
        word = np.repeat(np.arange(len(length)), length)
        start, n, piece, score = self.edges(chars, np.repeat(first + length, length))
        inside = start - first[word[start]]
        order = np.argsort(inside.astype(np.int32), kind="stable")
        start, n, piece, score, inside = (x[order] for x in (start, n, piece, score, inside))
        source = start + word[start]  # a word of n characters has n + 1 positions
        target = source + n
        best, through = np.full(len(chars) + len(length), -np.inf), np.zeros(len(chars) + len(length), np.int64)
        best[first + np.arange(len(length))] = 0
        cuts = np.searchsorted(inside, np.arange(length.max() + 1))
        for a, b in zip(cuts, cuts[1:]):  # the edges that start at the words' first characters, at their second ones, and so on; no two of them end in one position
            total = best[source[a:b]] + score[a:b]
            better = np.flatnonzero(total > best[target[a:b]])
            best[target[a + better]], through[target[a + better]] = total[better], a + better
        taken, at = np.full(len(chars), -1), first + length + np.arange(len(length))
        while len(at):
            edge = through[at]
            taken[start[edge]] = edge
            at = source[edge[inside[edge] > 0]]
        taken = taken[taken >= 0]
        size = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        count = np.where(piece[taken] >= 0, 1, size[start[taken]])
        out = np.repeat(piece[taken], count)
        byte = np.repeat((np.cumsum(size) - size)[start[taken]] - (np.cumsum(count) - count), count) + np.arange(len(out))
        out[out < 0] = data[byte[out < 0]].astype(np.int32) + self.byte0
        return out, np.bincount(word[start[taken]], count, len(length)).astype(np.int64)


def words_of(text, vocabulary: Vocabulary):
    """The words of a text column, the first with the mark that the encoder puts before every text; none for a null or empty text."""
    marked = F.translate(F.concat(F.lit(MARK), text), " ", MARK)
    return F.when(F.length(text) > 0, F.regexp_extract_all(marked, F.lit(vocabulary.pattern), F.lit(1)))


def _plain_ids(words: list[str], vocabulary: Vocabulary):
    known = {p: (i, s) for p, i, s in vocabulary.rows}
    for word in words:
        best = [(0.0, -1, ())] + [None] * len(word)
        for start in range(len(word)):
            for end in range(start + 1, min(len(word), start + vocabulary.longest) + 1):
                at = known.get(word[start:end])
                if at is None and end > start + 1:
                    continue
                path = (at[0],) if at else tuple(vocabulary.byte0 + b for b in word[start].encode())
                score = best[start][0] + (at[1] if at else vocabulary.unknown)
                if best[end] is None or score > best[end][0]:
                    best[end] = (score, start, path)
        out, at = [], len(word)
        while at > 0:
            out.append(best[at][2])
            at = best[at][1]
        yield [i for path in reversed(out) for i in path]


def _plain_viterbi(vocabulary: Vocabulary):
    def run(batches):
        for batch in batches:
            ids = [*_plain_ids(batch.column(0).to_pylist(), vocabulary)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "occurrences", "ids"])
    return run


def _folded(words: pa.Array, lattice: Lattice, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of `words`, one after another; how many each has)"""
    data, offsets = scan.joined(words)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    before, parts, i = np.r_[0, np.cumsum(length)], [], 0
    while i < len(words):
        if length[i] == 0 or length[i] > LONG:
            ids = np.array([*_plain_ids([words[i].as_py()], vocabulary)][0], np.int32)
            parts.append((ids, np.array([len(ids)])))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(before, before[i] + FOLDED, "right")) - 1)
        odd = np.flatnonzero((length[i:j] == 0) | (length[i:j] > LONG))
        j = i + int(odd[0]) if len(odd) else j
        parts.append(lattice.ids(data[offsets[i]:offsets[j]], length[i:j]))
        i = j
    return (np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def encode_words(words: DataFrame, vocabulary: Vocabulary) -> list[DataFrame]:
    """(word, occurrences, ids) of distinct words (word, occurrences), as two frames to be united: words up to `LONG` characters, and longer ones."""
    lattice, schema = vocabulary.lattice(), "word string, occurrences long, ids array<int>"
    small_batches(words.sparkSession)

    def fold(batches):
        for batch in batches:
            ids, n = _folded(batch.column(0), lattice, vocabulary)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(ids, pa.int32()))], names=["word", "occurrences", "ids"])
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short, long = (words.where(x).select("word", "occurrences") for x in (F.length("word") <= LONG, F.length("word") > LONG))
    return [short.repartition(parts, "word").mapInArrow(fold, schema), long.mapInArrow(_plain_viterbi(vocabulary), schema)]


def distinct_words(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, occurrences) over all texts of `docs`."""
    return docs.select(F.explode(words_of(F.col("text").cast("string"), vocabulary)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("occurrences"))


def _decoder(vocabulary: Vocabulary, at: int):
    def run(batches):
        spelled = {i: p.replace(MARK, " ").encode() for p, i, _ in vocabulary.rows} | {vocabulary.byte0 + b: bytes([b]) for b in range(256)}
        size = max(spelled) + 2  # the last entry is what an unknown id gives: nothing
        raw = [spelled.get(i, b"") for i in range(size)]
        length = np.array([len(x) for x in raw], np.int64)
        start, data = np.cumsum(length) - length, np.frombuffer(b"".join(raw), np.uint8)
        for batch in batches:
            ids = batch.column(at)
            bounds = np.r_[0, np.cumsum(np.nan_to_num(pc.list_value_length(ids).to_numpy(zero_copy_only=False)).astype(np.int64))]
            flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
            flat = np.where((flat >= 0) & (flat < size), flat, size - 1)
            texts, i = [], 0
            while i < batch.num_rows:  # rows of about `IDS` ids at a time
                j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + IDS, "right")) - 1)
                out, end = gathered(data, start, length, flat[bounds[i]:bounds[j]])
                out, end = out.tobytes(), end[bounds[i:j + 1] - bounds[i]].tolist()
                texts += [out[a:b].decode("utf-8", "replace") for a, b in zip(end, end[1:])]
                i = j
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[1:] if x[:1] == " " else x for x in texts], pa.string())], names=[*batch.schema.names, "text"])
    return run


def decode(encoded: DataFrame, vocabulary: Vocabulary, keys: list[str]) -> DataFrame:
    """`keys` and text of rows (keys, ids): a worker looks its rows' pieces up by id and joins them; byte pieces give their byte, marks are spaces.

    Rows stay where they are; `keys` may hold ids. The space before the first word is dropped. An unknown id gives nothing, no ids an empty text.
    """
    rows = encoded.select(*keys, *(["ids"] if "ids" not in keys else []))
    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.schema), StructField("text", StringType())])
    return rows.mapInArrow(_decoder(vocabulary, rows.columns.index("ids")), schema).select(*keys, "text")


def _packed(numbers: np.ndarray, width: int = 1) -> bytes:
    """32-bit numbers: how many, and their first, second, third and fourth bytes compressed, or their lower and upper halves (`width` 2, for numbers that follow one another in patterns)."""
    x = np.ascontiguousarray(numbers, np.int32)
    return len(x).to_bytes(8, "little") + _small(x.view(f"u{width}").reshape(-1, 4 // width).T.tobytes())


def _unpacked(packed, width: int = 1) -> np.ndarray:
    packed = pa.py_buffer(packed)
    n = int.from_bytes(packed[:8].to_pybytes(), "little")
    return np.ascontiguousarray(np.frombuffer(_large(packed[8:], 4 * n), f"u{width}").reshape(4 // width, n).T).view(np.int32).reshape(n)


def _small(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True) if data else b""


def _large(data, size: int):
    return pa.decompress(data, size, codec="zstd") if size else b""


def _blocks(batches):
    """Rows of about `BLOCK` bytes of text together."""
    held, size, rows = [], 0, 0
    for whole in batches:
        for i, j, data, _ in scan.text_batches(whole.column(2), BLOCK):
            if held and (size + len(data) > BLOCK or rows + j - i > ROWS):
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
            held.append(whole.slice(i, j - i))
            size, rows = size + len(data), rows + j - i
    if held:
        yield pa.Table.from_batches(held)


def _words_in(stretches: pa.Array, pattern) -> pa.Array:
    """The words of stretches that begin with spaces, one after another; Python holds a few at a time."""
    data, offsets = scan.joined(stretches)
    found, i = [pa.array([], pa.large_string())], 0
    while i < len(stretches):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STRETCH, "right")) - 1)
        text = data[offsets[i]:offsets[j]].tobytes().decode().replace(" ", MARK)
        if offsets[j] - offsets[i] <= STRETCH:
            found.append(pa.array(pattern.findall(text), pa.large_string()))
        else:
            words = (x[0] for x in pattern.finditer(text))
            while part := [*islice(words, TOKENS)]:
                found.append(pa.array(part, pa.large_string()))
        i = j
    return pa.concat_arrays(found)


def _numbered(text: pa.ChunkedArray, pattern) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words of the texts as numbers of distinct ones, one text after another; how many each text has; the distinct words)

    A run of spaces begins a word, so what stands from one to the next has the same words everywhere, and only distinct stretches are split.
    """
    if pc.any(pc.match_substring(text, MARK)).as_py():
        text = pc.replace_substring(text, MARK, " ")
    data, offsets = scan.joined(text)
    full = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][full], 32)
    offsets = np.r_[0, np.cumsum(np.diff(offsets) + full)]
    space = data == 32
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[offsets[:-1][full]] = True
    start = np.flatnonzero(begins)
    at = np.searchsorted(start, offsets)
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.r_[start, len(data)]), pa.py_buffer(data)]).dictionary_encode()
    which, stretches = coded.indices.to_numpy(), coded.dictionary
    del space, begins, start, data, coded
    data, offsets = scan.joined(stretches)
    blank = data[offsets[1:] - 1] == 32
    # blank stretches, which end a text, are words; each of the others begins with spaces, and nothing else in them does
    found = _words_in(stretches.filter(pa.array(~blank)), pattern)
    first = np.flatnonzero(pc.starts_with(found, MARK).to_numpy(zero_copy_only=False))
    coded = pa.concat_arrays([found, pc.replace_substring(stretches.filter(pa.array(blank)).cast(pa.large_string()), " ", MARK)]).dictionary_encode()
    begin, n = np.zeros(len(stretches), np.int64), np.ones(len(stretches), np.int64)
    begin[~blank], n[~blank] = first, np.diff(np.r_[first, len(found)])
    begin[blank] = np.arange(len(found), len(coded))
    places, end = gathered(coded.indices.to_numpy(), begin, n, which)
    return places, np.diff(end[at]), coded.dictionary


CARRIED = "key long, block long, bucket int, doc_id array<long>, text_hash array<long>, n_words binary, sizes binary, packed binary"


def _carried(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in CARRIED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=names)


def _split(pattern: str):
    """Blocks of texts: a row (bucket -1) of which of the block's distinct words stand in each text, the most frequent ones with the smallest numbers, and one for each bucket of distinct words.

    A block's name tells its texts and their order: if its rows came in another order when a lost task runs again, its parts could not be mistaken for those of the first run.
    """
    def run(batches):
        import regex
        from pyspark import TaskContext
        compiled, partition = regex.compile(pattern), TaskContext.get().partitionId()
        long = lambda *x: int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "little", signed=True)
        for k, table in enumerate(_blocks(batches)):
            places, n_words, words = _numbered(table.column(2), compiled)
            doc_id, text_hash = (table.column(c).to_pylist() for c in (0, 1))
            block = long(partition, k, text_hash)
            common = np.argsort(-np.bincount(places, minlength=len(words)), kind="stable")
            rank = np.zeros(len(words), np.int32)
            rank[common] = np.arange(len(words))
            words = words.take(pa.array(common))
            data, offsets = scan.joined(words)
            bucket = (scan.byte_prints(data, offsets[:-1], offsets[1:]) % scan.U(BUCKETS)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            yield _carried([(block, block, -1, doc_id, text_hash, _packed(n_words), _packed(np.diff(order, prepend=0)), _packed(rank[places]))])
            del table, places, n_words, doc_id, text_hash, common, rank, data, offsets
            cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                own, offsets = scan.joined(words.take(pa.array(order[cuts[b]:cuts[b + 1]])))
                yield _carried([(long(partition // NEAR, k // NEAR, b), block, b, None, None, None, _packed(np.diff(offsets)), len(own).to_bytes(8, "little") + _small(own.tobytes()))])
            del words, bucket, order, cuts
        trimmed()
    return run


def _looked_up(vocabulary: Vocabulary):
    """Buckets of words with the words' ids instead; the other rows as they are."""
    lattice = vocabulary.lattice()

    def coded(held):
        rows, words = zip(*held)
        words = pa.concat_arrays(words).dictionary_encode()
        ids, n = _folded(words.dictionary, lattice, vocabulary)
        which, start, i = words.indices.to_numpy(), np.cumsum(n) - n, 0
        for (key, block, bucket), size in zip(rows, (len(x) for _, x in held)):
            own = which[i:i + size]
            yield _carried([(key, block, bucket, None, None, None, _packed(n[own]), _packed(gathered(ids, start, n, own)[0], 2))])
            i += size

    def run(batches):
        held, size, n = [], 0, 0
        for batch in batches:
            buckets = batch.column(2).to_pylist()
            for k, bucket in enumerate(buckets):
                if bucket < 0:
                    yield batch.slice(k, 1)
                    continue
                sizes, packed = _unpacked(batch.column(6)[k].as_buffer()).astype(np.int64), batch.column(7)[k].as_buffer()
                data = _large(packed[8:], int.from_bytes(packed[:8].to_pybytes(), "little"))
                words = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)]), pa.py_buffer(data)])
                if held and (n + len(words) > WORDS or size + len(data) > WORD_BYTES):
                    yield from coded(held)
                    held, size, n = [], 0, 0
                held.append(((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), bucket), words))
                size, n = size + len(data), n + len(words)
        if held:
            yield from coded(held)
        trimmed()
    return run


def gathered(values: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the stretches of `values` that `which` names, in a row; where each ends, from 0)"""
    n = length[which]
    end = np.r_[0, np.cumsum(n)]
    return values[np.repeat(start[which] - end[:-1], n) + np.arange(end[-1])], end


def trimmed() -> None:
    """Give freed memory back, so that an idle worker does not hold it while the JVM sorts."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _placed(batches):
    """Ids of every text of a block, from those of its distinct words; rows come by block, and the places of words before the buckets."""
    def put(row, buckets):
        doc_id, text_hash, n_words, order, places = row or [None] * 5
        order, places = (np.cumsum(_unpacked(order), dtype=np.int64), _unpacked(places)) if row else ((), ())
        own = np.concatenate([_unpacked(x).astype(np.int64) for x, _ in buckets]) if buckets else np.zeros(0, np.int64)
        ids = np.concatenate([_unpacked(x, 2) for _, x in buckets]) if buckets else np.zeros(0, np.int32)
        if len(own) != len(order):
            raise ValueError("rows of a block came in another order when they were read again; write the documents to a table first")
        length, start = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        length[order], start[order] = own, np.cumsum(own) - own
        bounds, i = np.r_[0, np.cumsum(_unpacked(n_words), dtype=np.int64)], 0
        while i < len(doc_id):  # rows of about `IDS` words at a time
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + IDS, "right")) - 1)
            flat, end = gathered(ids, start, length, places[bounds[i]:bounds[j]])
            end = end[bounds[i:j + 1] - bounds[i]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([doc_id.slice(i, j - i), text_hash.slice(i, j - i), pa.ListArray.from_arrays(pa.array(end), pa.array(flat, pa.int32()))], names=["doc_id", "text_hash", "ids"])
            i = j

    block, row, buckets = None, None, []
    for batch in batches:
        blocks, numbers = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for k in range(batch.num_rows):
            if blocks[k] != block:
                if row or buckets:
                    yield from put(row, buckets)
                block, row, buckets = blocks[k], None, []
            value = [batch.column(c)[k] for c in range(3, 8)]
            if numbers[k] < 0:
                row = (value[0].values, value[1].values, *(x.as_buffer() for x in value[2:]))
            else:
                buckets.append((value[3].as_buffer(), value[4].as_buffer()))
    if row or buckets:
        yield from put(row, buckets)
    trimmed()


def _joined(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows of blocks of texts as `_placed` takes them: the places of words in a block, and the ids of its distinct words.

    A block keeps its words as numbers of its distinct words, and only these are dealt by their hash and come back as ids; occurrences are never
    shuffled one by one. All rows are moved twice and lie nowhere else. text_hash is Spark's 64-bit hash of a text, by which a round trip is checked.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    dealt = rows.mapInArrow(_split(vocabulary.pattern), CARRIED).repartition(parts, "key")
    return dealt.mapInArrow(_looked_up(vocabulary), CARRIED).repartition(parts, "block").sortWithinPartitions("block", "bucket")


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids) for every row of `docs` (doc_id, text; other columns are not read); a null or empty text has no ids; copies of rows give equal rows."""
    return _joined(docs, vocabulary).mapInArrow(_placed, "doc_id long, text_hash long, ids array<int>").select("doc_id", "ids")


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, decoded, same) for every row of `docs`: the ids of its whole text, the text that they decode to, and whether that is the row's own.

    A null text is an empty one. `same` compares 64-bit hashes. A mark in a text is the vocabulary's space, so such a text comes back with spaces instead and is not the same.
    """
    def both(batches):  # one Python worker a task encodes and decodes
        yield from _decoder(vocabulary, 2)(_placed(batches))
    back = _joined(docs, vocabulary).mapInArrow(both, "doc_id long, text_hash long, ids array<int>, text string")
    return back.select("doc_id", "ids", F.col("text").alias("decoded"), (F.xxhash64("text") == F.col("text_hash")).alias("same"))
