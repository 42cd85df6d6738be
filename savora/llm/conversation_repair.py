"""Repair of conversations' turn structure by rank-convergence parallel Viterbi.

A conversation's rows, by turn, are edited at least cost until their roles' initials read
``(s?(ua)+)?``: a row is kept (K, 0), given the role user or assistant (R, 2) or deleted (D, 3), and
rows without text are inserted (I, 2); a truncated row that stays costs 1; blank rows and duplicates
have to go. The automaton has four states (nothing yet, after s, after u, after a), and the backward
cost vector of a row tells what the rest costs from each of them. Up to a constant there are only
few such vectors (``VECTORS``, found by closure), so a row's step is a lookup.

All conversations lie in one global order (id, turn, role, text), cut into chunks of at most
``CHUNK`` rows. Chunks start from a speculative vector, as if the conversation ended after them. In
fix-up passes a chunk whose successor came to another vector reruns until its vectors differ from
the old ones by a constant only; the constants, summed up, give the costs. Chains that have not
settled after ``PASSES`` passes (vectors that never converge, such as alternating ones) take every
vector at once, and the chunks' tables are composed by doubling. With the vectors fixed, each chunk
is traced from each state, the states at the borders follow from composed exits, and each chunk
writes its part: at every row the least letter that is still cheapest, so the audit is ASCII-least.

Rows that must go never change a state. They are counted between the others (a third of all rows
may be copies of one), so chunks that do matter are found at once.

Defined results: nulls in id, role or text count as one space (a null id is a conversation of its
own, a null text is blank), turns that are null come first, ties are ordered by role and text;
very long texts lie in chunks of their own and are never cut; equal rows are counted, not spread;
roles with another initial are given a role or deleted; an empty table gives no rows; further
columns of any name are left alone. A digest over a whole conversation is one stream: its pieces,
small ones, pass through one task, which holds one of them and the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from savora.llm.common import materialize, read_table

CHUNK = 64
CHUNK_CHARS = 200_000
PASSES = 4
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: state -> initial -> state: nothing yet, after s, after u, after a.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
STATES = range(len(MOVES))
INITIALS = "sua?"
FINE = {("s", "u"), ("u", "a"), ("a", "u")}
SPACES = " \t\n\x0b\x0c\r"


def _inserted(costs: list[int]) -> list[int]:
    """The costs where rows may be inserted first."""
    costs = list(costs)
    for _ in STATES:
        for s in STATES:
            costs[s] = min([costs[s], *[INSERT + costs[t] for x, t in MOVES[s].items() if x in ROLES]])
    return costs


def _options(kind: int, state: int) -> list[tuple[str, int, int, str]]:
    """A row's edits: letter, cost, next state, new initial. kind: 2 * place in INITIALS + truncated."""
    own, late = INITIALS[kind // 2], kind % 2 * TRUNCATED
    kept = [("K", late, t, x) for x, t in MOVES[state].items() if x == own]
    return [("D", DELETE, state, ""), *kept, *[("R", REROLE + late, t, x) for x, t in MOVES[state].items() if x in ROLES]]


def _closure() -> tuple[list[tuple[int, ...]], list[list[tuple[int, int]]]]:
    """All cost vectors that arise, less their least entry, and for each kind and vector the vector before the row and its constant."""
    far = 10**6
    vectors, steps, k = [tuple(_inserted([0, far, far, 0]))], [[] for _ in range(2 * len(INITIALS))], 0
    while k < len(vectors):
        for kind, step in enumerate(steps):
            costs = _inserted([min(cost + vectors[k][t] for _, cost, t, _ in _options(kind, s)) for s in STATES])
            vector = tuple(c - min(costs) for c in costs)
            if vector not in vectors:
                vectors.append(vector)
            step.append((vectors.index(vector), min(costs)))
        k += 1
    return vectors, steps


VECTORS, STEPS = _closure()
END = 0  # the vector after the last row


def swept(kinds: str, into: int) -> tuple[int, int]:
    """The vector before the rows, and the constant they add."""
    total = 0
    for kind in reversed(kinds):
        into, c = STEPS[int(kind)][into]
        total += c
    return into, total


def rerun(kinds: str, old: int, new: int, out: int, const: int) -> tuple[int, int]:
    """As swept from ``new``, where ``old`` led to (out, const): it ends where the two differ by a constant only."""
    for kind in reversed(kinds):
        if old == new:
            return out, const
        (old, a), (new, b) = STEPS[int(kind)][old], STEPS[int(kind)][new]
        const += b - a
    return new, const


@lru_cache(maxsize=None)
def traced(kind: int, after: int, state: int) -> tuple[str, str, int]:
    """The least cheapest letters for a row, the initials of the rows they leave (empty for none), and the state after it."""
    before, const = STEPS[kind][after]
    letters, initials = "", []
    while True:
        left = VECTORS[before][state] + const
        edits = [(letter, t, x) for letter, cost, t, x in _options(kind, state) if cost + VECTORS[after][t] == left]
        edits += [("I", t, x) for x, t in MOVES[state].items() if x in ROLES and INSERT + VECTORS[before][t] + const == left]
        letter, state, x = min(edits)
        letters += letter
        initials.append(x)
        if letter != "I":
            return letters, "".join(initials), state


def vectors_of(kinds: str, into: int) -> list[int]:
    """The vector after each row."""
    out = [into]
    for kind in reversed(kinds[1:]):
        out.append(STEPS[int(kind)][out[-1]][0])
    return out[::-1][: len(kinds)]


def exits(kinds: str, into: int) -> list[int]:
    """The state after the rows, for each state before them."""
    after, out = vectors_of(kinds, into), []
    for state in STATES:
        for kind, v in zip(kinds, after, strict=True):
            state = traced(int(kind), v, state)[2]
        out.append(state)
    return out


def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, turn, role, text and copies: rows damaged by the checksum of id and turn (dropped rows have 0 copies)."""
    key = F.concat_ws(":", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (id_col, turn_col)])
    text, way = F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")), F.col("way")
    rows = conversations.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("way"))
    text = F.when(way == 1, "").when(way == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(way == 0, 0).when(way == 3, 2).otherwise(1)
    return rows.select("id", "turn", F.when(way == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def faults(turns: DataFrame) -> DataFrame:
    """Distinct rows with their number, n, and blank, truncated, again (role and text seen earlier); of the rows of no copies only the ids matter."""
    counted = turns.groupBy("id", "turn", "role", "text").agg(F.sum("copies").alias("n")).withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    first = counted.where("n > 0").groupBy(F.col("id").alias("i"), F.col("digest").alias("d")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first"))
    joined = counted.join(first, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left")
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    again = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return joined.select("id", "turn", "role", "text", "n", (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(*".!?")).alias("truncated"), F.coalesce(again, F.lit(False)).alias("again"))


CHUNK_FIELDS = "part int, seq int, id {id}, opens boolean, closes boolean, kinds string, runs array<long>, roles array<string>, texts array<string>, rows long, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long, head_turn long, tail_turn long, out int, const long"


class _Chunk:
    def __init__(self, key: tuple, opens: bool | None, most: int):
        self.key, self.opens, self.closes, self.most = key, opens, None, most
        self.kinds, self.runs, self.roles, self.texts, self.chars = [], [0], [], [], 0
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.head = self.tail = self.low = self.high = self.head_turn = self.tail_turn = None

    def full(self, text: str) -> bool:
        return bool(self.kinds) and (len(self.kinds) >= self.most or self.chars + len(text) > CHUNK_CHARS)

    def add(self, turn: int | None, role: str, text: str, n: int, blank: bool, truncated: bool, again: bool) -> None:
        if not n:
            return
        initial = role[:1]
        self.illegal += n - 1 + (self.rows > 0 and (self.tail, initial) not in FINE)
        self.head, self.tail, self.rows = initial if self.head is None else self.head, initial, self.rows + n
        if turn is not None:
            self.turns += turn != self.tail_turn
            self.low, self.high = turn if self.low is None else self.low, turn
            self.head_turn, self.tail_turn = turn if self.head_turn is None else self.head_turn, turn
        if blank:
            self.blank += n
        elif again:
            self.duplicate += n
        else:
            self.duplicate += n - 1
            self.truncated += truncated
            self.kinds.append(str(2 * "sua".find(initial) + truncated if initial and initial in "sua" else 6 + truncated))
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(text)
            self.runs.append(0)
            n -= 1
        self.runs[-1] += n

    def row(self, part: int, seq: int) -> tuple:
        kinds = "".join(self.kinds)
        return (part, seq, *self.key, self.opens, self.closes, kinds, self.runs, self.roles, self.texts, self.rows, self.blank, self.duplicate, self.truncated, self.illegal, self.head, self.tail, self.low, self.high, self.turns, self.head_turn, self.tail_turn, *swept(kinds, END))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema, weight: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1000 + weight(row)
        if size > 4_000_000:
            yield _table(held, schema)
            held, size = [], 0
    yield _table(held, schema)


def _chunks(schema: pa.Schema, most: int):
    """Sorted rows to chunks. opens, closes: null where the partition's edge hides whether the conversation goes on."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        chunk, part, seq = None, 0, 0
        for batch in batches:
            for p, key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk is not None and (key != chunk.key[0] or chunk.full(row[2])):
                    chunk.closes = key != chunk.key[0]
                    yield chunk.row(part, seq)
                    chunk, seq = _Chunk((key,), chunk.closes, most), seq + 1
                part, chunk = p, chunk or _Chunk((key,), None, most)
                chunk.add(*row)
        if chunk is not None:
            yield chunk.row(part, seq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(made(batches), schema, lambda r: sum(map(len, r[8])))

    return run


def _numbered(chunks: DataFrame) -> DataFrame:
    """Adds g, the chunk's number in the global order."""
    totals = {r["part"]: r["n"] for r in chunks.groupBy("part").agg((F.max("seq") + 1).alias("n")).collect()}  # one row for each shuffle partition
    before, offsets = 0, {}
    for part in sorted(totals):
        offsets[part], before = before, before + totals[part]
    if not offsets:
        return chunks.withColumn("g", F.lit(0).cast("long"))
    spark = chunks.sparkSession
    return chunks.join(F.broadcast(spark.createDataFrame(list(offsets.items()), "part int, offset long")), "part").withColumn("g", F.col("offset") + F.col("seq")).drop("offset")


def _neighbour(table: DataFrame, step: int, columns: dict[str, str]) -> DataFrame:
    """table with columns of the chunk ``step`` further on in the same conversation (null where there is none)."""
    other = table.select((F.col("g") - step).alias("_g"), F.col("id").alias("_id"), *[F.col(c).alias(n) for n, c in columns.items()])
    return table.join(other, (F.col("g") == F.col("_g")) & F.col("id").eqNullSafe(F.col("_id")), "left").drop("_g", "_id")


def composed(table: DataFrame, step: int, longest: int, tag: str) -> DataFrame:
    """table (g, id, f) with f following all f of the chunks further on in direction ``step``: by doubling."""
    reach = 1
    while reach < longest:
        paired = _neighbour(table, step * reach, {"inner": "f"})
        f = F.when(F.col("inner").isNull(), F.col("f")).otherwise(F.transform("inner", lambda x: F.element_at(F.col("f"), x + 1)))
        table = materialize(paired.select("g", "id", f.alias("f")), tag)
        reach *= 2
    return table


def _rerun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        g, key, kinds, into, out, const, new = (batch.column(k) for k in range(7))
        ran = [rerun(*x) for x in zip(kinds.to_pylist(), into.to_pylist(), new.to_pylist(), out.to_pylist(), const.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([g, key, kinds, new, pa.array([r[0] for r in ran], pa.int32()), pa.array([r[1] for r in ran], pa.int64())], names=["g", "id", "kinds", "into", "out", "const"])


def _mapped(what: Callable[..., list[int]], names: tuple[str, ...]):
    """g, id and f, a list for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [what(*x) for x in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["g", "id", "f"])

    return run


def _table_of(kinds: str) -> list[int]:
    return [swept(kinds, v)[0] for v in range(len(VECTORS))]


def settled(chunks: DataFrame, id_type: str, passes: int = PASSES) -> DataFrame:
    """g, id, into, out, const, entry, last of the chunks of conversations that have several, or may."""
    fields = f"g long, id {id_type}, kinds string, into int, out int, const long"
    state = materialize(chunks.select("g", "id", "kinds", F.lit(END).alias("into"), "out", "const"), "repair-state")
    longest = state.groupBy("id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(passes):
        new = F.coalesce("next", F.lit(END))
        paired = _neighbour(state, 1, {"next": "out"})
        if paired.where(F.col("into") != new).isEmpty():
            break
        state = materialize(paired.select("g", "id", "kinds", "into", "out", "const", new.alias("new")).mapInArrow(_rerun, fields), "repair-state")
    else:
        whole = state.select("g", "id", "kinds").mapInArrow(_mapped(_table_of, ("kinds",)), f"g long, id {id_type}, f array<int>")
        tables = composed(materialize(whole, "repair-tables"), 1, longest, "repair-tables")
        after = _neighbour(tables, 1, {"rest": "f"}).select(F.col("g").alias("_g"), F.coalesce(F.element_at("rest", END + 1), F.lit(END)).alias("new"))
        state = materialize(state.join(after, F.col("g") == F.col("_g")).select("g", "id", "kinds", "into", "out", "const", "new").mapInArrow(_rerun, fields), "repair-state")
    left = materialize(state.select("g", "id", "kinds", "into").mapInArrow(_mapped(exits, ("kinds", "into")), f"g long, id {id_type}, f array<int>"), "repair-exits")
    through = composed(left, -1, longest, "repair-exits")
    entry = _neighbour(through, -1, {"before": "f"}).select(F.col("g").alias("_g"), F.element_at("before", 1).alias("entry"))
    more = _neighbour(state, 1, {"next": "into"})
    return more.join(entry, F.col("g") == F.col("_g")).select("g", "into", "out", "const", F.col("entry").isNull().alias("first"), F.coalesce("entry", F.lit(0)).alias("entry"), F.col("next").isNull().alias("last"))


PIECE_FIELDS = "g long, id {id}, audit string, new_roles array<string>, new_texts array<string>, cost long, rows long, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long, head_turn long, tail_turn long"
_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "turns", "head_turn", "tail_turn")


def written(kinds: str, runs: list[int], roles: list[str], texts: list[str], into: int, state: int, last: bool) -> tuple[str, list[str], list[str]]:
    """A chunk's letters, and the roles and texts of its repaired rows."""
    letters, new_roles, new_texts = ["D" * runs[0]], [], []
    for kind, after, run, role, text in zip(kinds, vectors_of(kinds, into), runs[1:], roles, texts, strict=True):
        edits, initials, state = traced(int(kind), after, state)
        inserts = len(edits) - 1
        for x in initials[:inserts]:
            new_roles.append(ROLES[x])
            new_texts.append("")
        if edits[-1] != "D":
            new_roles.append(role if edits[-1] == "K" else ROLES[initials[inserts]])
            new_texts.append(text)
        letters += [edits, "D" * run]
    while last and VECTORS[END][state]:
        x, state = next((x, t) for x, t in MOVES[state].items() if x in ROLES)
        letters.append("I")
        new_roles.append(ROLES[x])
        new_texts.append("")
    return "".join(letters), new_roles, new_texts


def _pieces(schema: pa.Schema):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                audit, roles, texts = written(r["kinds"], r["runs"], r["roles"], r["texts"], r["into"], r["entry"], r["last"])
                gone = r["rows"] - len(r["kinds"])
                cost = r["const"] + DELETE * gone + (VECTORS[r["out"]][0] if r["first"] else 0)
                yield (r["g"], r["id"], audit, roles, texts, cost, *(r[c] for c in _COUNTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(made(batches), schema, lambda r: len(r[2]) + sum(map(len, r[4])))

    return run


def repair(turns: DataFrame, id_col: str = "id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None, chunk: int = CHUNK, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """Pieces of conversations that are one piece, and those of longer ones; copies: how often a row is there (0: only its id is known)."""
    id_type = turns.schema[id_col].dataType.simpleString()
    nothing = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = turns.select(F.col(f"`{id_col}`").alias("id"), F.expr(f"try_cast(`{turn_col}` AS BIGINT)").alias("turn"), nothing(role_col).alias("role"), nothing(text_col).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
    order = ["id", "turn", "role"]
    ranged = faults(rows).repartitionByRange(*order, F.substring("text", 1, 200)).sortWithinPartitions(*order, "text")
    fields = CHUNK_FIELDS.format(id=id_type)
    chunks = materialize(ranged.select(F.spark_partition_id().alias("part"), *order, "text", "n", "blank", "truncated", "again").mapInArrow(_chunks(to_arrow_schema(T.StructType.fromDDL(fields)), chunk), fields), "repair-chunks")
    single = F.coalesce(F.col("opens") & F.col("closes"), F.lit(False))
    numbered = _numbered(chunks)
    body = ("g", "id", "kinds", "runs", "roles", "texts", *_COUNTS)
    alone = numbered.where(single).select(*body, F.lit(END).alias("into"), "out", "const", F.lit(True).alias("first"), F.lit(0).alias("entry"), F.lit(True).alias("last"))
    known = settled(numbered.where(~single).select("g", "id", "kinds", "out", "const"), id_type, passes)
    longer = numbered.where(~single).select(*body).join(known, "g").select(*body, "into", "out", "const", "first", "entry", "last")
    fields = PIECE_FIELDS.format(id=id_type)
    run = _pieces(to_arrow_schema(T.StructType.fromDDL(fields)))
    return alone.mapInArrow(run, fields), longer.mapInArrow(run, fields)


def repaired_turns(turns: DataFrame, **names) -> DataFrame:
    """The repaired conversations themselves: id, piece and place (together the order), role, text."""
    alone, longer = repair(turns, **names)
    lines = F.posexplode(F.arrays_zip("new_roles", "new_texts")).alias("place", "x")
    return alone.unionByName(longer).select("id", F.col("g").alias("piece"), lines).select("id", "piece", "place", F.col("x.new_roles").alias("role"), F.col("x.new_texts").alias("text"))


REPORT_FIELDS = "id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _folded(schema: pa.Schema):
    """Pieces, in order, to a row for each conversation; the text is hashed as it passes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now = None
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or r["id"] != now["id"]:
                    if now is not None:
                        yield closed(now)
                    now = {"id": r["id"], "hash": hashlib.sha256(), "lines": 0, "audit": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "turns": 0, "low": None, "high": None, "tail": None, "tail_turn": None}
                for c in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                    now[c] += r[c]
                now["audit"].append(r["audit"])
                if r["rows"]:
                    now["illegal"] += now["tail"] is not None and (now["tail"], r["head"]) not in FINE
                    now["tail"] = r["tail"]
                if r["low"] is not None:
                    now["turns"] -= r["head_turn"] == now["tail_turn"]
                    now["tail_turn"] = r["tail_turn"]
                    now["low"], now["high"] = r["low"] if now["low"] is None else now["low"], r["high"]
                for role, text in zip(r["new_roles"], r["new_texts"], strict=True):
                    now["hash"].update(("\n" * (now["lines"] > 0) + f"{role}:{text}").encode())
                    now["lines"] += 1
        if now is not None:
            yield closed(now)

    def closed(now: dict) -> tuple:
        gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
        return now["id"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"], "".join(now["audit"]), now["hash"].hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(made(batches), schema, lambda r: len(r[7]))

    return run


def report(turns: DataFrame, **names) -> DataFrame:
    """A row for each conversation: faults, cost, audit, and the digest of the repaired rows."""
    alone, longer = repair(turns, **names)
    fields = REPORT_FIELDS.format(id=alone.schema["id"].dataType.simpleString())
    run = _folded(to_arrow_schema(T.StructType.fromDDL(fields)))
    return alone.mapInArrow(run, fields).unionByName(longer.repartition("id").sortWithinPartitions("id", "g").mapInArrow(run, fields))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damage(read_table(spark, sf_dir, "conversations"))
    return report(turns, copies=F.col("copies")).withColumnRenamed("id", "conv_id")


OP11_SQL = r"""
WITH RECURSIVE table_of AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS bytes FROM conversations
), ways AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS way FROM keyed, table_of
), hurt AS (
  SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN way = 3 THEN [1, 2] ELSE [1] END) AS copy FROM ways WHERE way <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, left(role, 1) AS initial FROM hurt
), judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS ends_early, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM placed
), turns AS (
  SELECT conv_id, n, initial, role, text, blank OR again AS gone, blank, again AND NOT blank AS duplicate, ends_early AND NOT blank AND NOT again AS truncated, turn, pair FROM judged
), counts AS (
  SELECT conv_id, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
    count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id
), moves(s, x, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), one AS (SELECT s, t, CASE x WHEN 'u' THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END AS lines FROM moves WHERE x <> 's'
), ins AS (
  SELECT unnest(range(4)) AS s, s AS t, 0 AS cost, '' AS letters, '' AS lines UNION ALL SELECT s, t, 2, 'I', lines FROM one
  UNION ALL SELECT a.s, b.t, 4, 'II', a.lines || b.lines FROM one a JOIN one b ON a.t = b.s
), edits AS (
  SELECT conv_id, n, s, s AS t, 3 AS cost, 'D' AS letter, '' AS out FROM turns, (SELECT unnest(range(4)) AS s)
  UNION ALL SELECT conv_id, n, s, t, CAST(truncated AS INTEGER), 'K', chr(10) || role || ':' || text FROM turns JOIN moves ON x = initial WHERE NOT gone
  UNION ALL SELECT conv_id, n, s, t, 2 + CAST(truncated AS INTEGER), 'R', lines || text FROM turns, one WHERE NOT gone
), walk(conv_id, n, s, cost, audit, out) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, 0, '', '' FROM counts
  UNION ALL
  SELECT * FROM (
    SELECT w.conv_id, e.n, e.t, w.cost + i.cost + e.cost AS cost, w.audit || i.letters || e.letter AS audit, w.out || i.lines || e.out AS out
    FROM walk w JOIN ins i ON i.s = w.s JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.n = w.n + 1 AND e.s = i.t
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, t ORDER BY cost, audit) = 1
), ended AS (
  SELECT w.conv_id, w.cost + i.cost AS cost, w.audit || i.letters AS audit, w.out || i.lines AS out
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.n = c.n_rows JOIN ins i ON i.s = w.s AND i.t IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + i.cost, w.audit || i.letters) = 1
)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(out[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM k.conv_id
"""
