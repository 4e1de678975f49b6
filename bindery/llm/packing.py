"""Best-fit packing of tokenised documents into fixed-length sequences by bin completion.

Documents become pieces of at most ``capacity`` tokens. How to fill sequences depends on the lengths
alone, so the corpus is reduced to a histogram with at most ``capacity`` rows. On it a branch and
bound search completes one sequence at a time: around the largest length left it enumerates the
fillings which no other filling dominates, takes the same filling as often as the counts allow, and
cuts a branch when the waste so far rules out beating the incumbent. A best-fit solution is the
first incumbent. The plan, rank intervals per length, is bounded by ``capacity`` too: a sequence holds
at most ``sqrt(2 * capacity)`` distinct lengths. Pieces then take their place by their rank among the
pieces of their length; a length may hold any share of the rows, ranks are counted in salted parts.

Defined cases: a null or empty text is the end token alone; a repeated row is a document of its own;
texts longer than a sequence are cut into full pieces and a shorter last one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import give_back_memory, materialize, numbered, ranked_rows

CAPACITY = 2048
#: rows of one length per part when ranks are counted
ROWS_PER_PART = 1_000_000
#: words a worker keeps the ids of, about 200 bytes each
KEPT_WORDS = 400_000
#: words encoded at a time
LEARNT_WORDS = 4096
#: words encoded as one text, with an added token between them
JOINED_WORDS = 64
SEPARATOR = "<|word|>"
# one stop or comma between a letter and white space
STOP = re.compile(r"([.,])(?<=[a-zß-öø-ÿ][.,])(?=\s|$)")
ASCII_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")


class Ids:
    """Token ids of whole texts as little-endian 32-bit integers, word by word.

    The tokenizer splits at white space before it does anything that looks at neighbours, so a
    text's ids are those of its words in turn, and words recur. Nor does it matter to it whether a
    letter is upper case, or whether a single stop or comma behind a word stands apart. Its added
    tokens begin with ``<|``.

    New words go to the tokenizer some at a time, between separators which no word holds a part of:
    an added token ends whatever stands before it. Words in lower case and Latin-1 are what the
    tokenizer's normalizer would make of them, so they pass a copy without one, on the same model.
    """

    def __init__(self, tokenizer, known: dict[str, bytes], parts: tuple | None = None):
        self.tokenizer, self.known = tokenizer, known
        self.spelt, self.any = parts or (between(tokenizer, False), between(tokenizer, True))

    def words(self, text: str) -> tuple[list[str], bool]:
        """The words, and whether they are in lower case and Latin-1."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            plain = False
        else:
            plain = "<|" not in text
        if plain:
            text = STOP.sub(r" \1", text.lower())
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to split(), not to the tokenizer
            return [w for w in ASCII_SPACE.split(text) if w], plain
        return text.split(), plain

    def learn(self, words: set[str], plain: bool) -> None:
        new = list(words)
        if not plain and any("<|" in w for w in new):  # may hold added tokens
            self._each([w for w in new if "<|" in w])
            new = [w for w in new if "<|" not in w]
        tokenizer = self.spelt if plain else self.any
        end = tokenizer.token_to_id(SEPARATOR)
        # an encoding holds far more than ids: a few at a time, as one text may bring a million words
        for at in range(0, len(new), LEARNT_WORDS):
            groups = [new[i : i + JOINED_WORDS] for i in range(at, min(at + LEARNT_WORDS, len(new)), JOINED_WORDS)]
            found = tokenizer.encode_batch_fast([SEPARATOR.join(g) for g in groups], add_special_tokens=False)
            for group, e in zip(groups, found, strict=True):
                ids = np.array(e.ids, "<u4")
                raw, begin = ids.tobytes(), 0
                for word, stop in zip(group, [*(np.flatnonzero(ids == end) * 4).tolist(), len(raw)], strict=True):
                    self.known[word] = raw[begin:stop]
                    begin = stop + 4

    def _each(self, words: list[str]) -> None:
        for at in range(0, len(words), LEARNT_WORDS):
            some = words[at : at + LEARNT_WORDS]
            for word, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                self.known[word] = array("I", e.ids).tobytes()

    def of(self, texts: list[str]) -> Iterator[bytes]:
        known = self.known
        for text in texts:
            words, plain = self.words(text)
            if len(known) > KEPT_WORDS:
                known.clear()
            if missing := set(words).difference(known):
                self.learn(missing, plain)
            yield b"".join(map(known.__getitem__, words))


def between(tokenizer, normalize: bool):
    """A tokenizer on the same model for words between separators, with the normalizer or without."""
    import tokenizers

    out = tokenizers.Tokenizer(tokenizer.model)
    if normalize and tokenizer.normalizer is not None:
        out.normalizer = tokenizer.normalizer
    if tokenizer.pre_tokenizer is not None:
        out.pre_tokenizer = tokenizer.pre_tokenizer
    out.add_special_tokens([SEPARATOR])
    return out


def load(name: str) -> Ids:
    """The tokenizer of this worker, with the words it knows; ``name`` is a path or a public tokenizer's file name."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    held = tokenizers.__dict__.setdefault("_bindery_ids", {})
    if name not in held:
        import public_tokenizers

        tokenizer = tokenizers.Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))
        held[name] = (tokenizer, {}, (between(tokenizer, False), between(tokenizer, True)))
    return Ids(*held[name])


def token_pieces(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """``uid, doc_id, piece, start, length, ids_crc32`` and on request ``ids``: every text's tokens and ``end_id``, cut. For writing."""
    table = numbered(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    schema = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = load(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256).to_pydict()
                out: list[tuple] = []
                for uid, doc_id, raw in zip(part["uid"], part["doc_id"], ids.of(part["text"]), strict=True):
                    raw += end
                    for n, a in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[a : a + 4 * capacity]
                        row = (uid, doc_id, n, a // 4, len(cut) // 4, zlib.crc32(cut))
                        out.append((*row, np.frombuffer(cut, "<u4").astype(np.int32)) if with_ids else row)
                names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
                columns = zip(*out, strict=True) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)
        # the next task brings about as many words as are kept; until then others need the memory
        ids.known.clear()
        give_back_memory()

    return table.select("uid", "doc_id", "text").mapInArrow(run, schema)


# a filling of one sequence: (length, times), largest length first
Filling = tuple[tuple[int, int], ...]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on a histogram: fillings and how often each occurs."""
    open_bins: dict[int, dict[Filling, int]] = {}
    rooms: list[int] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = next((i for i, r in enumerate(rooms) if r >= length), None)
            if at is None:  # open sequences, each filled with this length as far as it goes
                per = min(capacity // length, left)
                bins = left // per
                _put(open_bins, rooms, capacity - per * length, ((length, per),), bins)
                left -= bins * per
                continue
            room = rooms[at]
            filling, bins = open_bins[room].popitem()
            per = min(room // length, left)
            used = min(bins, left // per)
            if bins > used:
                open_bins[room][filling] = bins - used
            elif not open_bins[room]:
                del open_bins[room], rooms[at]
            _put(open_bins, rooms, room - per * length, (*filling, (length, per)), used)
            left -= used * per
    return [(f, n) for fillings in open_bins.values() for f, n in fillings.items()]


def _put(open_bins: dict[int, dict[Filling, int]], rooms: list[int], room: int, filling: Filling, bins: int) -> None:
    if room not in open_bins:
        open_bins[room] = {}
        rooms.insert(bisect_right(rooms, room), room)
    open_bins[room][filling] = open_bins[room].get(filling, 0) + bins


def dominates(a: list[int], b: list[int]) -> bool:
    """Whether the items of ``b`` can be put, in groups, in the place of items of ``a``."""
    if sum(a) < sum(b):
        return False

    def place(i: int, rooms: tuple[int, ...]) -> bool:
        if i == len(b):
            return True
        return any(r >= b[i] and place(i + 1, (*rooms[:j], r - b[i], *rooms[j + 1 :])) for j, r in enumerate(rooms) if r not in rooms[:j])

    return place(0, tuple(a))


def fillings(lengths: list[int], counts: dict[int, int], room: int, width: int) -> list[list[int]]:
    """Undominated ways to fill ``room``, least waste first; ``lengths`` ascending, those with counts above 0.

    At most ``width`` steps are spent on the enumeration. One item which fits exactly dominates all else.
    """
    if counts.get(room, 0):
        return [[room]]
    found: list[list[int]] = []
    steps = 0

    def extend(taken: list[int], left: int, upto: int) -> None:
        nonlocal steps
        steps += 1
        if counts.get(left, 0) > taken.count(left) and left <= upto and left:
            found.append([*taken, left])
            return
        top = bisect_right(lengths, min(left, upto))
        grown = False
        for i in range(top - 1, -1, -1):
            if steps >= width:
                break
            length = lengths[i]
            if counts[length] > taken.count(length):
                grown = True
                extend([*taken, length], left - length, length)
                if found and sum(found[-1]) == room and len(taken) > 0:
                    break  # this start is completed without waste
        if not grown and taken:
            # maximal only if nothing at all fits
            smallest = next((x for x in lengths if counts[x] > taken.count(x)), None)
            if smallest is None or smallest > left:
                found.append(taken)

    extend([], room, room)
    found.sort(key=lambda f: (room - sum(f), len(f)))
    kept: list[list[int]] = []
    for f in found[:16]:
        if len(f) > 8 or not any(len(k) <= 8 and dominates(k, f) for k in kept):
            kept.append(f)
    return kept


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's bound: long items exclude each other, the waste they force, and the volume of the rest."""
    lengths = sorted(counts)
    total = sum(k * n for k, n in counts.items())
    best = -(-total // capacity)
    for cut in [x for x in lengths if 2 * x <= capacity] or [0]:
        huge = sum(n for k, n in counts.items() if k > capacity - cut)
        large = sum(n for k, n in counts.items() if capacity - cut >= k > capacity // 2)
        volume = sum(k * n for k, n in counts.items() if capacity - cut >= k > capacity // 2)
        small = sum(k * n for k, n in counts.items() if capacity // 2 >= k >= cut and k)
        best = max(best, huge + large + max(0, -(-(small - (large * capacity - volume)) // capacity)))
    return best


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 8_000, width: int = 64) -> list[tuple[Filling, int]]:
    """The fewest sequences found for a histogram: fillings and how often each is used.

    A depth-first search over fillings of the largest length left. It ends when a solution meets the
    lower bound, or after ``nodes`` steps with the best one found; ``width`` bounds the enumeration at
    a step. Both bound the driver's work whatever the number of documents.
    """
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return []
    incumbent = best_fit(counts, capacity)
    best = sum(n for _, n in incumbent)
    # a solution of the search which is as good takes the incumbent's place once
    goal, met = lower_bound(counts, capacity), False
    lengths = sorted(counts)
    left = sum(k * n for k, n in counts.items())
    path: list[tuple[Filling, int, Iterator]] = []
    used = 0

    def choices() -> Iterator[tuple[Filling, int]]:
        largest = lengths[-1]
        counts[largest] -= 1
        options = fillings([x for x in lengths if counts[x]], counts, capacity - largest, width) or [[]]
        counts[largest] += 1
        for rest in options:
            items: dict[int, int] = {largest: 1}
            for x in rest:
                items[x] = items.get(x, 0) + 1
            filling = tuple(sorted(items.items(), reverse=True))
            yield filling, min(counts[k] // times for k, times in filling)

    pending = choices()
    while nodes > 0:
        step = next(pending, None)
        if step is None:  # all fillings here are tried: undo the last one
            if not path:
                break
            filling, times, pending = path.pop()
            for k, n in filling:
                if not counts[k]:
                    lengths.insert(bisect_right(lengths, k), k)
                counts[k] += n * times
                left += k * n * times
            used -= times
            continue
        nodes -= 1
        filling, times = step
        for k, n in filling:
            counts[k] -= n * times
            left -= k * n * times
            if not counts[k]:
                lengths.remove(k)
        used += times
        path.append((filling, times, pending))
        bound = used + -(-left // capacity)
        if not left and (used < best or (used == best and not met)):
            incumbent, best, met = [(f, n) for f, n, _ in path], used, True
            if best <= goal:
                break
        # the waste so far leaves no room to be better
        pending = iter(()) if not left or bound > best or (bound == best and met) else choices()
    return incumbent


def intervals(plan: list[tuple[Filling, int]]) -> dict[str, np.ndarray]:
    """The plan as rank intervals, sorted by length and rank: which pieces of a length go where."""
    rows, upto, sequence = [], {}, 0
    for filling, bins in plan:
        base = 0
        for length, times in filling:
            lo = upto.get(length, 0)
            upto[length] = lo + bins * times
            rows.append((length, lo, sequence, times, base))
            base += length * times
        sequence += bins
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "lo", "sequence", "times", "base"), columns, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("uid", "piece")) -> DataFrame:
    """Add ``sequence_id, offset`` to written ``pieces``, which have ``length`` and unique ``keys``."""
    # at most one row per length up to the capacity
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = intervals(bin_completion(histogram, capacity))
    parts = max(1, -(-max(histogram.values(), default=0) // ROWS_PER_PART))
    ranked = ranked_rows(pieces, ["length"], list(keys), "_rank", parts)
    most = max(histogram.values(), default=0) + 1
    starts = plan["length"] * most + plan["lo"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(starts, length * most + rank, side="right") - 1
            k, times = rank - plan["lo"][at], plan["times"][at]
            kept = batch.drop_columns(["_rank"])
            made = [pa.array(plan["sequence"][at] + k // times), pa.array(plan["base"][at] + k % times * length)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*kept.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*pieces.columns, "_rank").mapInArrow(place, schema)


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` with ``with_ids``)."""
    pieces = materialize(token_pieces(docs, capacity=capacity, **options), "token-pieces")
    return pack(pieces, capacity).drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, from pieces ``with_ids``; a sequence is bounded by the capacity."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))

