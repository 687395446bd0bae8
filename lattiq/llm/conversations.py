"""Repair of the structure of conversations: a min-plus matrix scan over their turns.

A good conversation is empty or reads: perhaps a system turn, then pairs of user and assistant. Its roles' initials lead through four states:
nothing yet, after a system turn, after a user's, after an assistant's. A turn is kept, given another role, or deleted, and turns may be inserted,
each at a price. So a turn is a 4x4 matrix from state to state, whose elements are (cost, audit), the audit being the edits' initials; it begins with
the closure over inserts. The product of two matrices adds costs, joins audits and takes the least pair. That least is the same however products are nested:
of two audits between the same states over the same turns one is never the other's beginning at an equal cost, as inserts cost more than nothing.

Rows are range partitioned and sorted by conversation and turn, so that a long conversation lies in several partitions. One that lies in a single partition
is worked out there in one pass. The others, fewer than there are partitions, give one matrix for each partition, and an associative tree of products over
these, in rounds of FAN, gives the audit; the partitions' repaired turns are then made apart.
The hash of a whole repaired conversation can't be split: one task reads its turns in order, piece by piece, without holding them.

Order: by turn (nulls first), then role and text. Role and text of a row may be null and are then read as one space.

Defined results: rows with null conv_id are one conversation; repeated rows count as rows of their own (all but the first are duplicates); a conversation with no rows
has zeros, an empty audit and the hash of the empty string; rows that equal in conversation, turn, role and the first 64 characters of text lie in one partition; an
empty table gives no rows; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm._common import cut, small_batches, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: A state after each role's initial; 0 is before the first turn.
AFTER = {"s": 1, "u": 2, "a": 3}
#: The initials that may come next in each state, and the states in which a conversation may end.
NEXT, ENDS = ("su", "u", "a", "u"), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Matrices that are multiplied in one round of the tree over partitions.
FAN = 8
#: Characters of repaired turns that a row of a long conversation holds (about).
LINES_CHARS = 1 << 20

#: A matrix: (cost, audit) for each pair of states, or None where none leads to the other.
Matrix = tuple[tuple[tuple[int, str] | None, ...], ...]


def _least(*elements):
    return min((e for e in elements if e is not None), default=None)


def product(left: Matrix, right: Matrix) -> Matrix:
    """The matrix of first left, then right."""
    return tuple(
        tuple(
            _least(*((x[0] + right[k][j][0], x[1] + right[k][j][1]) for k, x in enumerate(row) if x is not None and right[k][j] is not None))
            for j in range(4)
        )
        for row in left
    )


def _matrix(edges: dict[tuple[int, int], list[tuple[int, str]]]) -> Matrix:
    return tuple(tuple(_least(*edges.get((i, j), [])) for j in range(4)) for i in range(4))


UNIT = _matrix({(i, i): [(0, "")] for i in range(4)})
_ONE_INSERT = _matrix({(i, i): [(0, "")] for i in range(4)} | {(i, AFTER[c]): [(INSERT, "I")] for i in range(4) for c in NEXT[i] if c in ROLES})
#: Any number of inserts: from no state does more than three lead anywhere new.
INSERTS = reduce(product, [_ONE_INSERT] * 3)


@lru_cache(maxsize=None)
def turn_matrix(initial: str, must_go: bool, truncated: bool) -> Matrix:
    """Inserts, then what may be done with one turn. Initials beyond s, u, a fare alike."""
    more = TRUNCATED if truncated else 0
    edges: dict[tuple[int, int], list[tuple[int, str]]] = {(i, i): [(DELETE, "D")] for i in range(4)}
    for i in range(0 if must_go else 4):
        for c in NEXT[i]:
            if c == initial:
                edges.setdefault((i, AFTER[c]), []).append((KEEP + more, "K"))
            if c in ROLES:
                edges.setdefault((i, AFTER[c]), []).append((REROLE + more, "R"))
    return product(INSERTS, _matrix(edges))


#: Turns as letters: initial (o is any other), capital if truncated; x must go.
LETTERS = {c: (c.lower(), False, c.isupper()) for c in "suaoSUAO"} | {"x": ("", True, False)}


@lru_cache(maxsize=50_000)
def _few(letters: str) -> Matrix:
    return reduce(product, (turn_matrix(*LETTERS[c]) for c in letters), UNIT)


def run_matrix(letters: str) -> Matrix:
    """The product over turns, as a balanced tree above runs of eight."""
    if len(letters) <= 8:
        return _few(letters)
    half = max(8, len(letters) // 2 // 8 * 8)
    return product(run_matrix(letters[:half]), run_matrix(letters[half:]))


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """(cost, audit) of a whole conversation from the product of its turns."""
    whole = product(matrix, INSERTS)
    return _least(*(whole[0][j] for j in ENDS))


def repaired(audit: str, roles: list[str], texts: list[str], state: int = 0) -> Iterator[str]:
    """The lines of a repaired conversation, or of a part that begins in a state."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        role = roles[at] if edit == "K" else ROLES[NEXT[state][-1]]
        yield f"{role}:{'' if edit == 'I' else texts[at]}"
        state = AFTER[role[:1]]
        at += edit != "I"


_SPACES = " \t\n\v\f\r"


class Part:
    """Turns of one conversation that follow on each other."""

    def __init__(self):
        self.turns: list[int | None] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.seen: set[tuple[str, str]] = set()
        self.letters: list[str] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn: int | None, role: str, text: str, seen_before: bool = False) -> None:
        """``seen_before``: whether an earlier part has this role and text."""
        last = text.rstrip(_SPACES)[-1:]
        if not last:
            fault = "blank"
        elif seen_before or (role, text) in self.seen:
            fault = "duplicate"
        else:
            fault = "" if last in ".!?" else "truncated"
        self.seen.add((role, text))
        if fault:
            self.counts[fault] += 1
        initial = role[:1] if role[:1] in AFTER else "o"
        self.letters.append("x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)

    def summary(self) -> dict:
        """What joins with the summaries of the parts before and after."""
        held = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        found = {"first_turn": held[0] if held else None, "last_turn": held[-1] if held else None, "distinct_turns": len(set(held))}
        return found | self.counts | {"illegal": illegal, "first_initial": initials[0], "last_initial": initials[-1], "matrix": run_matrix("".join(self.letters))}


def joined(left: dict, right: dict) -> dict:
    """The summary of two parts in a row; associative."""
    found = {k: left[k] + right[k] for k in ("distinct_turns", "blank", "duplicate", "truncated", "illegal")}
    found["distinct_turns"] -= left["last_turn"] is not None and left["last_turn"] == right["first_turn"]
    found["illegal"] += left["last_initial"] + right["first_initial"] not in ("su", "ua", "au")
    first, last = ("first_turn", "first_initial"), ("last_turn", "last_initial")
    found |= {first[0]: right[first[0]] if left[first[0]] is None else left[first[0]], last[0]: left[last[0]] if right[last[0]] is None else right[last[0]]}
    return found | {first[1]: left[first[1]], last[1]: right[last[1]], "matrix": product(left["matrix"], right["matrix"])}


def gaps(part: dict) -> int:
    return 0 if part["first_turn"] is None else part["last_turn"] - part["first_turn"] + 1 - part["distinct_turns"]


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = "conv_id {0}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
#: A part's summary as columns: the matrix as costs (-1 for none) and audits, row by row.
PART = "conv_id {0}, part long, n_rows long, first_turn long, last_turn long, distinct_turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, costs array<long>, audits array<string>"


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _flat(part: dict) -> dict:
    cells = [e for row in part.pop("matrix") for e in row]
    return part | {"costs": [-1 if e is None else e[0] for e in cells], "audits": ["" if e is None else e[1] for e in cells]}


def _deep(row: dict) -> dict:
    cells = [None if c < 0 else (c, a) for c, a in zip(row.pop("costs"), row.pop("audits"))]
    return row | {"matrix": tuple(tuple(cells[i : i + 4]) for i in range(0, 16, 4))}


def _schema(ddl: str, like) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl.format(like.simpleString())))


def whole_conversations(schema: pa.Schema):
    """A pass over sorted (conv_id, turn, role, text) that gives each conversation's result."""

    def result(conv, part: Part) -> dict:
        own = part.summary()
        cost, audit = cheapest(own["matrix"])
        text = "\n".join(repaired(audit, part.roles, part.texts))
        counts = {"gaps": gaps(own), "cost": cost} | {k: own[k] for k in ("blank", "duplicate", "truncated", "illegal")}
        return {"conv_id": conv, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()} | counts

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, done = None, None, []
        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if part is None or own != conv:
                    if part is not None:
                        done.append(result(conv, part))
                    part, conv = Part(), own
                part.add(*row)
            if done:
                yield _batch(done, schema)
                done = []
        if part is not None:
            yield _batch([result(conv, part)], schema)

    return scan


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of rows(conv_id, turn, role, text)."""
    spark = rows.sparkSession
    small_batches(spark)
    kind = rows.schema["conv_id"].dataType
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv_id", "turn", "role", "text")
    placed = cut(ranged.withColumn("place", F.monotonically_increasing_id()))
    # conversations that go on beyond a partition: each partition's edge belongs to one, so there are fewer than partitions
    part = F.shiftright("place", 33)
    edges = placed.groupBy("conv_id").agg(F.min(part).alias("first"), F.max(part).alias("last"))
    spread = cut(edges.where(F.col("first") < F.col("last")).select(F.col("conv_id").alias("long_id")))
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = placed.join(F.broadcast(spread), same, "left_anti").select("conv_id", "turn", "role", "text")
    result = RESULT.format(kind.simpleString())
    found = short.mapInArrow(whole_conversations(_schema(RESULT, kind)), result)
    if spread.isEmpty():
        return found
    long = placed.join(F.broadcast(spread), same).select("conv_id", "turn", "role", "text", "place", part.alias("part"))
    return found.union(_repair_long(long, kind, placed.rdd.getNumPartitions()))


def _repair_long(rows: DataFrame, kind, partitions: int) -> DataFrame:
    """The same of conversations in several parts: sorted rows with place and part."""
    part_ddl, part_schema, result_schema = PART.format(kind.simpleString()), _schema(PART, kind), _schema(RESULT, kind)
    # rows whose role and text stand in an earlier part of the conversation
    key = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    keyed = rows.withColumn("key", key)
    first = keyed.groupBy("conv_id", "key").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first < last")
    first = first.select(F.col("conv_id").alias("of"), F.col("key").alias("of_key"), "first")
    marked = keyed.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    marked = cut(marked.select("conv_id", "part", "place", "turn", "role", "text", F.coalesce(F.col("part") > F.col("first"), F.lit(False)).alias("before")))

    def in_order(table: pa.Table) -> pa.Table:
        return table.sort_by("place")

    def summarise(table: pa.Table) -> pa.Table:
        part = Part()
        for row in zip(*(in_order(table)[c].to_pylist() for c in ("turn", "role", "text", "before"))):
            part.add(*row)
        head = {"conv_id": table["conv_id"][0].as_py(), "part": table["part"][0].as_py(), "n_rows": len(table)}
        return pa.Table.from_pylist([head | _flat(part.summary())], schema=part_schema)

    def multiply(table: pa.Table) -> pa.Table:
        parts = [_deep(r) for r in table.sort_by("part").to_pylist()]
        head = {"conv_id": parts[0]["conv_id"], "part": parts[0]["part"] // FAN, "n_rows": sum(p["n_rows"] for p in parts)}
        return pa.Table.from_pylist([_flat(reduce(joined, parts)) | head], schema=part_schema)

    def finish(table: pa.Table) -> pa.Table:
        own = _deep(table.to_pylist()[0])
        cost, audit = cheapest(own["matrix"])
        row = {"conv_id": own["conv_id"], "gaps": gaps(own), "cost": cost, "audit": audit}
        return pa.Table.from_pylist([row | {k: own[k] for k in ("blank", "duplicate", "truncated", "illegal")}], schema=result_schema)

    parts = cut(marked.groupBy("conv_id", "part").applyInArrow(summarise, part_ddl))
    level, width = parts, partitions
    while width > 1:
        level = level.groupBy("conv_id", F.floor(F.col("part") / FAN).alias("step")).applyInArrow(multiply, part_ddl)
        width = -(-width // FAN)
    audits = cut(level.groupBy("conv_id").applyInArrow(finish, RESULT.format(kind.simpleString())).drop("repaired_sha256"))

    def share(table: pa.Table) -> pa.Table:
        """Each part's edits with the inserts before them (the last part takes those at the end), and the state that it begins in."""
        rows, at, found = table.sort_by("part").to_pylist(), 0, []
        audit = rows[0]["audit"]
        before, after = 0, len(audit) - audit.count("D")
        for k, row in enumerate(rows):
            end, left = at, row["n_rows"]
            while left:
                left -= audit[end] != "I"
                end += 1
            own = audit[at:] if k + 1 == len(rows) else audit[at:end]
            # an even number of turns to come begins with a user's
            found.append({"conv_id": row["conv_id"], "part": row["part"], "own": own, "state": 0 if not before else 2 if after % 2 else 3})
            before, after, at = before + len(own) - own.count("D"), after - len(own) + own.count("D"), end
        return pa.Table.from_pylist(found, schema=share_schema)

    share_ddl, lines_ddl = "conv_id {0}, part long, own string, state int".format(kind.simpleString()), "conv_id {0}, part long, step int, lines string".format(kind.simpleString())
    share_schema, lines_schema, hash_schema = (_schema(x, kind) for x in (share_ddl, lines_ddl, "conv_id {0}, sha string"))
    known = audits.select(F.col("conv_id").alias("of"), "audit")
    shares = parts.select("conv_id", "part", "n_rows").join(known, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    shares = shares.groupBy("conv_id").applyInArrow(share, share_ddl)

    def lines(turns: pa.Table, shares: pa.Table) -> pa.Table:
        """The part's repaired turns in runs of about LINES_CHARS characters."""
        own, turns = shares.to_pylist()[0], in_order(turns)
        runs, held, size = [], [], 0
        for line in repaired(own["own"], turns["role"].to_pylist(), turns["text"].to_pylist(), own["state"]):
            held.append(line)
            size += len(line)
            if size >= LINES_CHARS:
                runs, held, size = [*runs, "\n".join(held)], [], 0
        runs += ["\n".join(held)] if held else []
        return pa.Table.from_pylist([{"conv_id": own["conv_id"], "part": own["part"], "step": k, "lines": x} for k, x in enumerate(runs)], schema=lines_schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            for own, run in zip(*(batch.column(k).to_pylist() for k in range(2))):
                if state is not None and own != conv:
                    yield _batch([{"conv_id": conv, "sha": state.hexdigest()}], hash_schema)
                    state = None
                if state is None:
                    conv, state = own, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(run.encode("utf-8", "surrogatepass"))
        if state is not None:
            yield _batch([{"conv_id": conv, "sha": state.hexdigest()}], hash_schema)

    made = marked.groupBy("conv_id", "part").cogroup(shares.groupBy("conv_id", "part")).applyInArrow(lines, lines_ddl)
    made = made.repartition("conv_id").sortWithinPartitions("conv_id", "part", "step").select("conv_id", "lines")
    hashes = made.mapInArrow(digest, "of {0}, sha string".format(kind.simpleString()))
    found = audits.join(hashes, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return found.select("conv_id", *COUNTS, "audit", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by crc32 of conv_id:turn modulo 20: 0 drops a row, 1 empties its text, 2 takes its full stops,
    exclamation and question marks, 3 repeats it, 4 makes it the user's. Nulls are read as one space."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(as_text("text"), "[.!?]", "")).otherwise(as_text("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))
    role = F.when(kind == 4, "user").otherwise(as_text("role"))
    return conversations.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, after damage."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damage(rows)).withColumnRenamed("conv_id", "of")
    every = rows.select("conv_id").distinct()
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    columns = [F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c) for c in [*COUNTS, "audit", "repaired_sha256"]]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select("conv_id", *columns)


_CRC = """(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT))),
   lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20)"""


def _sql_step(prefix: str, more: str, *lines: str) -> str:
    """SQL of an element with edits appended: cost, audit and repaired lines."""
    return "{'c': " + f"{prefix}.c + {more.split()[0]}, 'a': {prefix}.a || '{more.split()[1]}', 'r': {prefix}.r" + "".join(f" || {x}" for x in lines) + "}"


_USER, _ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_CLOSE = f"""p0 AS q0, p1 AS q1, list_min([p2, {_sql_step('p0', '3 I', _USER)}, {_sql_step('p1', '3 I', _USER)}, {_sql_step('p3', '3 I', _USER)}]) AS q2,
  list_min([p3, {_sql_step('p2', '3 I', _ASSISTANT)}, {_sql_step('p0', '6 II', _USER, _ASSISTANT)}, {_sql_step('p1', '6 II', _USER, _ASSISTANT)}]) AS q3"""
_GO = "CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000000 ELSE 0 END"


def _sql_turn(state: int, initial: str, sources: str, role: str | None) -> str:
    """SQL of the least element that ends in a state after one turn."""
    found = [_sql_step(f"q{state}", "4 D")]
    for k in sources:
        keep, make = (f"{cost} + ({_GO}) + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END" for cost in (f"CASE WHEN left(role, 1) = '{initial}' THEN 0 ELSE 1000000000000 END", 3))
        found.append("{'c': " + f"q{k}.c + {keep}, 'a': q{k}.a || 'K', 'r': q{k}.r || chr(10) || role || ':' || text" + "}")
        if role:
            found.append("{'c': " + f"q{k}.c + {make}, 'a': q{k}.a || 'R', 'r': q{k}.r || {role} || text" + "}")
    return f"list_min([{', '.join(found)}])"


#: The same turn by turn: a recursion over the least way to each of the four states.
ORACLE = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} AS h FROM conversations),
m AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
   unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM m),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
   left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM o),
g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
w(conv_id, i, p0, p1, p2, p3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}}, {{'c': CAST(1000000000000 AS BIGINT), 'a': '', 'r': ''}}, {{'c': CAST(1000000000000 AS BIGINT), 'a': '', 'r': ''}}, {{'c': CAST(1000000000000 AS BIGINT), 'a': '', 'r': ''}} FROM g
  UNION ALL
  SELECT conv_id, i, {_sql_turn(0, '', '', None)}, {_sql_turn(1, 's', '0', None)}, {_sql_turn(2, 'u', '013', _USER)}, {_sql_turn(3, 'a', '2', _ASSISTANT)}
  FROM (SELECT w.conv_id, f.i, f.role, f.text, f.fault, {_CLOSE} FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)),
e AS (SELECT conv_id, list_min([q0, q3]) AS best FROM (SELECT w.conv_id, {_CLOSE} FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.n = w.i))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
   coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(substr(coalesce(best.r, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
