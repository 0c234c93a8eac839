"""Conversation repair: faults of turns, and the cheapest edits that make the roles alternate.

Turns become symbols, and runs of a conversation's symbols words of bounded
length, so a conversation with a third of all rows is many words.  Different
words are few; they are packed by Re-Pair rules that all conversations share,
and get one transfer matrix each (``repair_grammar``).  Two streams of words, one
in each direction, choose every conversation's states; the words' ropes then are
the edits, which meet the texts in one last sorted stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import read_table, saved
from vigil.llm.repair_grammar import FIRST_RULE, INSERT, KEPT, LAST, NEXT, ROLE, STATES, Grammar, read_symbol, symbol

#: Symbols of one word.
WORD = 1024
#: Rounds of pairing, and new rules of one round: at most 1,536 rules, which bounds what goes to every task.
#: What is left of a word after the last round is multiplied symbol by symbol.
ROUNDS, RULES_A_ROUND = 12, 128
ROWS_AT_ONCE = 4096
_WHITE = " \t\n\x0b\x0c\r"
_NONE = 10 ** 9
_KEYS = ["c", "late", "turn", "role", "digest"]
_KEY_TYPES = "c string, late boolean, turn long, role string, digest binary"


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, turn_col, role_col, text_col) with faults planted by crc32('conv:turn') mod 20: 0 drops the row, 1 empties
    its text, 2 removes ``[.!?]`` from it, 3 repeats the row, 4 makes the role user.  NULLs read as one space, but a NULL
    conversation and a NULL turn stay NULL in the result."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.encode(F.concat(plain(conv_col), F.lit(":"), plain(turn_col)), "UTF-8")) % 20
    rows = turns.select(conv_col, turn_col, plain(role_col).alias(role_col), plain(text_col).alias(text_col), h.alias("__h")).filter("__h <> 0")
    text = F.when(F.col("__h") == 1, "").when(F.col("__h") == 2, F.regexp_replace(text_col, "[.!?]", "")).otherwise(F.col(text_col))
    role = F.when(F.col("__h") == 4, "user").otherwise(F.col(role_col))
    copies = F.when(F.col("__h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn(text_col, text).withColumn(role_col, role).withColumn("__h", F.explode(copies)).drop("__h")


def _keyed(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows with a conversation key that is never NULL, and the order inside a conversation: turn (NULL first), role, text."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(_conv_key(conv_col).alias("c"), F.col(turn_col).isNotNull().alias("late"), F.col(turn_col).cast("long").alias("turn"),
                        plain(role_col).alias("role"), F.unhex(F.sha2(F.encode(plain(text_col), "UTF-8"), 256)).alias("digest"),
                        plain(text_col).alias("text"))


def _conv_key(conv_col: str) -> Column:
    return F.when(F.col(conv_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(conv_col).cast("string")))


def _marked(rows: DataFrame) -> DataFrame:
    """One row per different (conversation, turn, role, text): how often, the symbol of the first and of the others."""
    end = F.right(F.rtrim(F.col("text"), F.lit(_WHITE)), F.lit(1))
    light = (rows.withColumn("end", end).groupBy(*_KEYS).agg(F.count("*").alias("copies"), F.first("end").alias("end")))
    at = F.struct("late", "turn")
    seen = light.groupBy("c", "role", "digest").agg(F.min(at).alias("seen"))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    blank = F.col("end") == ""
    first = F.when(blank, "blank").when(at > F.col("seen"), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated").otherwise("")
    name = F.create_map(*[x for i in "suax" for f in ("", "blank", "duplicate", "truncated") for x in (F.lit(f"{i}:{f}"), F.lit(symbol(i, f)))])
    return (light.join(seen, ["c", "role", "digest"]).withColumn("initial", initial)
            .select(*_KEYS, "copies", name[F.concat("initial", F.lit(":"), first)].alias("first"),
                    name[F.concat("initial", F.lit(":"), F.when(blank, "blank").otherwise("duplicate"))].alias("others")))


def _words(marked: DataFrame) -> DataFrame:
    """(keys of the first row, copy, symbols, copies): a conversation's symbols in order, WORD at a time.

    ``copy`` tells how many copies of the first row came before; ``copies`` how many symbols each row has in the word.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, symbols, copies, room, out = None, [], [], 0, []

        def close():
            nonlocal head, symbols, copies, room
            if head is not None:
                out.append((*head, "".join(symbols), copies))
            head, symbols, copies, room = None, [], [], WORD

        for batch in batches:
            for *key, n, first, others in zip(*[batch.column(k).to_pylist() for k in range(8)]):
                if head is not None and head[0] != key[0]:
                    close()
                done = 0
                while done < n:
                    if head is None or not room:
                        close()
                        head = (*key, done)
                    part = min(n - done, room)
                    symbols.append(first + others * (part - 1) if not done else others * part)
                    copies.append(part)
                    done, room = done + part, room - part
                    if len(out) >= ROWS_AT_ONCE:
                        yield _batch(out, _WORD_TYPES)
                        out.clear()
        close()
        if out:
            yield _batch(out, _WORD_TYPES)

    spread = marked.repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS)
    return spread.mapInArrow(run, _KEY_TYPES + ", copy long, symbols string, copies array<long>")


_WORD_TYPES = pa.schema([("c", pa.string()), ("late", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()),
                         ("copy", pa.int64()), ("symbols", pa.string()), ("copies", pa.list_(pa.int64()))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(column), t.type) for column, t in zip(zip(*rows), schema)], schema=schema)


def re_pair(words: DataFrame, rounds: int = ROUNDS, at_once: int = RULES_A_ROUND) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(words with a column ``packed``, the rules): Re-Pair on the column ``symbols``, each word counted ``n`` times.

    The most frequent pair that occurs twice becomes a symbol of its own, again and again.  Pairs of which none ends
    with a symbol that another begins with cannot overlap, so a round replaces many: the counts of one stay true while
    the others are replaced.  Pairs of one symbol are counted without overlap.  The rules, at most ``rounds`` x
    ``at_once``, are all that the driver holds.
    """
    packed, rules = words.withColumn("packed", F.col("symbols")), []
    for _ in range(rounds):
        runs = F.regexp_extract_all("packed", F.lit(r"(.)\1*"), F.lit(0))
        inside = F.transform(F.filter("runs", lambda r: F.length(r) > 1), lambda r: F.struct(
            F.substring(r, 1, 2).alias("pair"), F.floor(F.length(r) / 2).alias("times")))
        between = F.transform(F.arrays_zip(F.slice("runs", F.lit(1), F.size("runs") - 1).alias("l"), F.slice("runs", F.lit(2), F.size("runs")).alias("r")),
                              lambda z: F.struct(F.concat(F.right(z["l"], F.lit(1)), F.substring(z["r"], 1, 1)).alias("pair"), F.lit(1).cast("long").alias("times")))
        counts = (packed.withColumn("runs", runs).select("n", F.explode(F.concat(inside, between)).alias("p"))
                  .groupBy("p.pair").agg(F.sum(F.col("n") * F.col("p.times")).alias("n")).filter("n > 1"))
        new: list[tuple[str, str]] = []
        begins, ends = set(), set()
        for pair in (r["pair"] for r in counts.orderBy(F.desc("n"), "pair").limit(4 * at_once).collect()):
            left, right = pair
            if len(new) < at_once and left not in ends and right not in begins:
                new.append((left, right))
                begins.add(left)
                ends.add(right)
        if not new:
            break
        pairs = F.array(*[F.struct(F.lit(left + right).alias("pair"), F.lit(chr(FIRST_RULE + len(rules) + k)).alias("name"))
                          for k, (left, right) in enumerate(new)])
        packed = saved(packed.withColumn("packed", F.reduce(pairs, F.col("packed"), lambda text, p: F.replace(text, p["pair"], p["name"]))), "packed")
        rules += new
    return packed, rules


def _evaluated(packed: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(symbols, packed, costs, ranks, faults, illegal, begins, ends) of every different word."""
    schema = pa.schema([("symbols", pa.string()), ("packed", pa.string()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())),
                        ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                        ("begins", pa.string()), ("ends", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        for batch in batches:
            rows = []
            for symbols, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entries = [e for row in grammar.matrix(text) for e in row]
                initials, faults = zip(*map(read_symbol, symbols))
                rows.append((symbols, text, [e[0] if e else _NONE for e in entries], [e[1] if e else 0 for e in entries],
                             faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                             sum(not _legal(a, b) for a, b in zip(initials, initials[1:])), initials[0], initials[-1]))
            if rows:
                yield _batch(rows, schema)

    return packed.select("symbols", "packed").mapInArrow(run, "symbols string, packed string, costs array<long>, ranks array<long>, blank long, "
                                                             "duplicate long, truncated long, illegal long, begins string, ends string")


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


_WORD = [*_KEYS, "copy", "copies", "packed"]
_PATH_SQL = _KEY_TYPES + (", copy long, copies array<long>, packed string, back array<long>, place long, final long, cost long, "
                          "blank long, duplicate long, truncated long, illegal long")
_PATH = pa.schema([*[f for f in _WORD_TYPES if f.name != "symbols" and f.name != "copies"], ("copies", pa.list_(pa.int64())), ("packed", pa.string()),
                   ("back", pa.list_(pa.int64())), *[(k, pa.int64()) for k in ("place", "final", "cost", "blank", "duplicate", "truncated", "illegal")]])


def _forward(words: DataFrame) -> DataFrame:
    """Per word its place in the conversation and the best state before it for each state behind it; per conversation one
    row with its ``final`` state, cost and counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, place, front, totals, ends, out = None, 0, None, None, None, []

        def close():
            if name is not None:
                reached = [(front[j][0] + INSERT * len(LAST[j]), front[j][1], j) for j in STATES if front[j]]
                cost, _, final = min(reached)
                out.append((name, *[None] * 8, place, final, cost, *totals))

        for batch in batches:
            for *word, costs, ranks, blank, duplicate, truncated, illegal, begins, last in zip(*[c.to_pylist() for c in batch.columns]):
                if word[0] != name:
                    close()
                    name, place, front, totals, ends = word[0], 0, [(0, 0), None, None, None], [0, 0, 0, 0], None
                ways = [[(front[i][0] + costs[4 * i + j], front[i][1], i) for i in STATES if front[i] and costs[4 * i + j] < _NONE] for j in STATES]
                best = [min(w) if w else None for w in ways]
                order = sorted((b[1], ranks[4 * b[2] + j]) for j, b in enumerate(best) if b)
                front = [b and (b[0], order.index((b[1], ranks[4 * b[2] + j]))) for j, b in enumerate(best)]
                out.append((*word, [b[2] if b else -1 for b in best], place, *[None] * 6))
                crossing = ends is not None and not _legal(ends, begins)
                totals = [totals[0] + blank, totals[1] + duplicate, totals[2] + truncated, totals[3] + illegal + crossing]
                place, ends = place + 1, last
            if len(out) >= ROWS_AT_ONCE:
                yield _batch(out, _PATH)
                out.clear()
        close()
        if out:
            yield _batch(out, _PATH)

    spread = words.repartition("c").sortWithinPartitions(*_KEYS, "copy")
    return spread.select(*_WORD, "costs", "ranks", "blank", "duplicate", "truncated", "illegal", "begins", "ends").mapInArrow(run, _PATH_SQL)


_PIECE = pa.schema([*[f for f in _WORD_TYPES if f.name not in ("symbols", "copies")], ("copies", pa.list_(pa.int64())), ("place", pa.int64()),
                    ("before", pa.int64()), ("piece", pa.string())])


def _edits(paths: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(keys, copy, copies, place, before, piece): the initials of every word's edits and the state before it, chosen from
    each conversation's last word back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, state = Grammar(rules), None
        for batch in batches:
            out = []
            for *word, packed, back, place, final in zip(*[c.to_pylist() for c in batch.columns]):
                if final is not None:
                    state = final
                    continue
                out.append((*word, place, back[state], grammar.audit(packed, back[state], state)))
                state = back[state]
            if out:
                yield _batch(out, _PIECE)

    spread = paths.repartition("c").sortWithinPartitions("c", F.desc("place"))
    return spread.select(*_WORD, "back", "place", "final").mapInArrow(
        run, _KEY_TYPES + ", copy long, copies array<long>, place long, before long, piece string")


class _Editor:
    """Applies the edits of one conversation to its turns as both stream by."""

    def __init__(self):
        self.conv, self.row = None, None

    def word(self, key, copy, piece, before, copies):
        if key[0] != self.conv:
            self.conv, self.row = key[0], None
        self.piece, self.at, self.state, self.copies, self.turn = piece, 0, before, copies, 0
        return self._apply(None, None) if copy else []

    def text(self, key, role, text):
        if key == self.row:          # a further copy: its edits were done with the first one's
            return []
        self.row = key
        return self._apply(role, text)

    def _apply(self, role, text):
        out, left = [], self.copies[self.turn]
        self.turn += 1
        while left:
            edit = self.piece[self.at]
            self.at += 1
            if edit == "I":
                self.state = NEXT[self.state]
                out.append((ROLE[self.state], "", edit))
                continue
            left -= 1
            if edit == "K":
                self.state = KEPT[role[0], self.state]
                out.append((role, text, edit))
            elif edit == "R":
                self.state = NEXT[self.state]
                out.append((ROLE[self.state], text, edit))
        return out

    def end(self, c, final):
        self.conv, out, state = c, [], final
        for _ in LAST[final]:
            state = NEXT[state]
            out.append((ROLE[state], "", "I"))
        return out


_REPAIRED = pa.schema([("c", pa.string()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def _repaired(rows: DataFrame, pieces: DataFrame, ends: DataFrame) -> DataFrame:
    """(c, role, text, edit) of the turns that stay or come in, in order within each partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = _Editor()
        for batch in batches:
            out, size = [], 0
            for c, late, turn, role, digest, kind, copy, piece, state, copies, text in zip(*[batch.column(k).to_pylist() for k in range(11)]):
                key = (c, late, turn, role, digest)
                made = editor.text(key, role, text) if kind == 1 else editor.end(c, state) if kind == 2 else editor.word(key, copy, piece, state, copies)
                out += [(c, *m) for m in made]
                size += len(made) and len(text or "")
                if len(out) >= ROWS_AT_ONCE or size > 1 << 24:
                    yield _batch(out, _REPAIRED)
                    out, size = [], 0
            if out:
                yield _batch(out, _REPAIRED)

    none = lambda kind: F.lit(None).cast(kind)
    columns = [*_KEYS, "kind", "copy", "piece", "state", "copies", "text"]
    edits = pieces.withColumns({"kind": F.lit(0), "state": F.col("before"), "text": none("string")}).select(*columns)
    texts = rows.withColumns({"kind": F.lit(1), "copy": F.lit(0).cast("long"), "piece": none("string"), "state": none("long"),
                              "copies": none("array<long>")}).select(*columns)
    last = ends.select("c", none("boolean").alias("late"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"),
                       F.lit(2).alias("kind"), none("long").alias("copy"), none("string").alias("piece"), F.col("final").alias("state"),
                       none("array<long>").alias("copies"), none("string").alias("text"))
    stream = edits.unionByName(texts).unionByName(last).repartition("c")
    stream = stream.sortWithinPartitions("c", F.col("late").asc_nulls_last(), "turn", "role", "digest", "copy", "kind")
    return stream.mapInArrow(run, "c string, role string, text string, edit string")


def _digests(repaired: DataFrame) -> DataFrame:
    """(c, repaired_sha256): one digest per conversation, fed turn by turn as the sorted rows stream by."""
    schema = pa.schema([("c", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, out = None, None, []
        for batch in batches:
            for c, role, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if c != name:
                    if name is not None:
                        out.append((name, state.hexdigest()))
                    name, state = c, sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if len(out) >= ROWS_AT_ONCE:
                yield _batch(out, schema)
                out = []
        if name is not None:
            out.append((name, state.hexdigest()))
        if out:
            yield _batch(out, schema)

    return repaired.mapInArrow(run, "c string, repaired_sha256 string")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, repaired turns) of a table of turns.

    Rows of a conversation count by turn, NULL first; rows of one turn by role and the text's SHA-256; equal rows are
    repeats.  A turn's first fault counts: blank (only ASCII white space), duplicate (its role and text came before),
    truncated (the last other character is none of ``.!?``).  Edits: keep (K) at no cost, rename the role to user or
    assistant (R, 2), delete (D, 3; blank and duplicate turns must go), insert an empty user or assistant turn (I, 2); a
    truncated turn that stays adds 1.  The roles' initials then read ``(s?(ua)+)?``; of the cheapest ways the one whose
    initials come first in ASCII is taken.  NULL roles and texts read as one space, an empty role has no initial and can
    only be renamed or deleted; NULL conversations are one conversation.

    report: c (the conversation's key, see ``_conv_key``), gaps, blank, duplicate, truncated, illegal (neighbours whose
    initials are not su, ua or au), cost, audit.  repaired turns: c, role, text, edit, in order within a partition.  A
    conversation's turns pass one task as a stream; only its audit, which is one value, is held whole.  An empty table
    gives no rows.
    """
    rows = _keyed(turns, conv_col, turn_col, role_col, text_col)
    marked = saved(_marked(rows), "turn-symbols")
    words = saved(_words(marked), "turn-words")
    packed, rules = re_pair(saved(words.groupBy("symbols").agg(F.count("*").alias("n")), "turn-dictionary"))
    known = saved(_evaluated(packed, rules), "turn-matrices")
    full = words.join(known, "symbols")
    paths = saved(_forward(full), "turn-paths")
    ends = paths.filter("final IS NOT NULL")
    pieces = saved(_edits(paths, rules), "turn-edits")
    audit = (pieces.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("p"))
             .select("c", F.array_join(F.col("p.piece"), "").alias("front")))
    gaps = (marked.select("c", "turn").distinct().groupBy("c")
            .agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")))
    last = F.element_at(F.create_map(*[x for j in STATES for x in (F.lit(j), F.lit(LAST[j]))]), F.col("final").cast("int"))
    report = (ends.join(audit, "c").join(gaps, "c")
              .select("c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.concat("front", last).alias("audit")))
    return report, _repaired(rows, pieces, ends)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: damage, faults and cheapest repair of the whole ``conversations`` table."""
    turns = read_table(spark, sf_dir, "conversations")
    report, repaired = repair(damaged(turns))
    every = turns.select("conv_id").distinct().withColumn("c", _conv_key("conv_id"))
    out = every.join(report, "c", "left").join(_digests(repaired), "c", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(F.col(k), F.lit(0)).cast("long").alias(k) for k in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))
