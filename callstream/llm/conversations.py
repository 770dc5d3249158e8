"""Repair of the structure of conversations by a Viterbi search with survivor coalescence."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructType

from callstream.llm.common import in_arrow
from callstream.llm.spelling import crc32_sql

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: Nothing kept yet; a system turn; a user turn that waits for its answer; an answer.
START, SYSTEM, USER, ANSWER = range(4)
_AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ANSWER: USER}, "a": {USER: ANSWER}}
_ROLE = {USER: "user", ANSWER: "assistant"}
#: The most by which a state can cost less than another from here on: what it takes to follow
#: any course of the other one. EXTRA[better][other]; with 0, every course is open to it as is.
_EXTRA = {
    START: {SYSTEM: 0, USER: 2, ANSWER: 4},
    SYSTEM: {START: 4, USER: 2, ANSWER: 4},
    USER: {START: 5, SYSTEM: 2, ANSWER: 2},
    ANSWER: {START: 3, SYSTEM: 0, USER: 2},
}
_BATCH = 2_000


class Node:
    """An edit that some survivor's course contains; counted by what refers to it."""

    __slots__ = ("parent", "depth", "letter", "role", "row", "children", "held")

    def __init__(self, parent: Node | None, letter: str, role: str | None, row):
        self.parent, self.letter, self.role, self.row = parent, letter, role, row
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.held = 0  # survivors that end here
        if parent:
            parent.children.append(self)


def _before(one: Node, two: Node, last_one: str = "", last_two: str = "") -> bool:
    """Whether the edits to ``one`` (and a last one) come before those to ``two`` in ASCII order.

    Both are read back to their common ancestor, the whole way that is not settled yet.
    """
    first, second = [last_one], [last_two]
    while one is not two:
        if one.depth >= two.depth:
            first.append(one.letter)
            one = one.parent
        else:
            second.append(two.letter)
            two = two.parent
    return "".join(reversed(first)) < "".join(reversed(second))


class Survivors:
    """The cheapest course of edits to each state, of equal ones the first in ASCII order.

    ``step`` takes a row and returns the edits that are settled by then: those of the part that
    the courses of all states have in common. Only what follows it is kept. States that cannot
    be on the best course any more are dropped first, so that they hold nothing back.
    """

    def __init__(self):
        self.root = Node(None, "", None, None)
        self.root.held = 1
        self.best: dict[int, tuple[int, Node]] = {START: (0, self.root)}

    def _offer(self, found: dict, state: int, cost: int, parent: Node, letter: str, row) -> None:
        """A way to ``state`` by a new edit, kept as (cost, parent, letter, row) until chosen."""
        other = found.get(state)
        if other is not None:
            least, course, last, _ = other
            if least < cost or (least == cost and not _before(parent, course, letter, last)):
                return
        found[state] = (cost, parent, letter, row)

    def _moved(self, found: dict) -> None:
        """Take the chosen ways; nodes that no survivor's course contains any more are freed."""
        old = list(self.best.values())
        self.best = {}
        for state, (cost, parent, letter, row) in found.items():
            node = parent
            if letter:
                role = _ROLE.get(state) if letter in (REROLE, INSERT) else (row[1] if row else None)
                node = Node(parent, letter, role, row)
            node.held += 1
            self.best[state] = (cost, node)
        for _, node in old:
            self._let_go(node)

    @staticmethod
    def _let_go(node: Node) -> None:
        node.held -= 1
        while not node.held and not node.children and node.parent:
            node.parent.children.remove(node)
            node = node.parent

    def _insert(self) -> None:
        """Inserted turns: up to two in a row are ever of use."""
        for state, sources in ((USER, (START, SYSTEM, ANSWER)), (ANSWER, (USER,))):
            found = {s: (c, n, "", None) for s, (c, n) in self.best.items()}
            for source in sources:
                if source in self.best:
                    cost, node = self.best[source]
                    self._offer(found, state, cost + COST[INSERT], node, INSERT, None)
            self._moved(found)

    def _prune(self) -> None:
        for state in list(self.best):
            cost, node = self.best[state]
            for other, (less, course) in self.best.items():
                if other == state:
                    continue
                extra = _EXTRA[other][state]
                if less + extra < cost or (not extra and less == cost and _before(course, node)):
                    del self.best[state]
                    self._let_go(node)
                    break

    def _settled(self) -> list[Node]:
        done = []
        while not self.root.held and len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            done.append(self.root)
        return done

    def step(self, row: tuple) -> list[Node]:
        """``row`` is (turn, role, text, fault); see ``Survivors``."""
        self._insert()
        fault, initial = row[3], row[1][:1]
        found: dict = {}
        broken = fault in ("blank", "duplicate")
        for state, (cost, node) in self.best.items():
            self._offer(found, state, cost + COST[DELETE], node, DELETE, row)
            if broken:
                continue
            cost += fault == "truncated"
            if state in _AFTER.get(initial, {}):
                self._offer(found, _AFTER[initial][state], cost, node, KEEP, row)
            target = ANSWER if state == USER else USER
            self._offer(found, target, cost + COST[REROLE], node, REROLE, row)
        self._moved(found)
        self._prune()
        return self._settled()

    def end(self) -> list[Node]:
        """The edits not settled before, of the best course that ends well."""
        self._insert()
        ends = [self.best[s] for s in (START, ANSWER) if s in self.best]
        least = min(cost for cost, _ in ends)
        nodes = [node for cost, node in ends if cost == least]
        node = nodes[0]
        for other in nodes[1:]:
            if _before(other, node):
                node = other
        course = []
        while node is not self.root:
            course.append(node)
            node = node.parent
        return course[::-1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _repaired(id_type: pa.DataType) -> Callable:
    """Edits of the conversations, each one's rows together and in order."""
    names = ["conv_id", "place", "edit", "turn", "fault", "from_role", "role", "text"]
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        place = 0

        def wrote(conv, nodes: list[Node]) -> None:
            nonlocal place
            for node in nodes:
                turn, from_role, text, fault = node.row or (None, None, "", None)
                role = None if node.letter == DELETE else node.role
                out.append((conv, place, node.letter, turn, fault, from_role, role, text))
                place += 1

        def taken() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        current, search = None, None
        for conv, *row in _rows(batches):
            if search is None or conv != current:
                if search is not None:
                    wrote(current, search.end())
                current, search, place = conv, Survivors(), 0
            wrote(conv, search.step(tuple(row)))
            if len(out) >= _BATCH:
                yield taken()
        if search is not None:
            wrote(current, search.end())
        if out:
            yield taken()

    return run


def _last_sign(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the first ``fault`` of each row; conversations whole and in
    order within the partitions.

    Order: by turn, nulls first, then role and text. One shuffle, by conversation; what is seen
    earlier in a conversation is found by a window over its equal turns, which spills.
    """
    filled = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).repartition("conv_id")
    equal = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    last = _last_sign(F.col("text"))
    fault = (
        F.when(last == "", "blank")
        .when(F.row_number().over(equal) > 1, "duplicate")
        .when(~last.isin(*ENDS), "truncated")
    )
    found = filled.withColumn("__seen", F.row_number().over(equal)).withColumn("fault", fault)
    return found.sortWithinPartitions("conv_id", "turn", "role", "text", "__seen").drop("__seen")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The cheapest edits that give each conversation the form ``(s?(ua)+)?`` of role initials.

    Returns a row per edit: conv_id, place (from 0), edit, turn, fault, from_role, role, text.
    Keep (K) costs 0, Rerole (R) to user or assistant 2, Delete (D) 3, Insert (I) of an empty
    user or assistant turn 2; blank and duplicate rows must go, truncated ones that stay add 1.
    Of equal courses the one whose edit letters come first in ASCII order is taken. ``role`` is
    that of the repaired turn, null for deleted rows.

    Each conversation streams through one task, as the digest of its repaired text must be
    taken in order; the search keeps only the edits that are not settled (``Survivors``), few
    unless roles repeat without end: then two courses, a turn apart, stay open.

    A null conv_id is one conversation. Null roles and texts are one blank each, so such rows
    are of no known role, or blank. Rows are ordered by turn (nulls first), role and text;
    repeated rows are duplicates. Other columns are not read. An empty table gives an empty one.
    """
    kind = rows.schema["conv_id"].dataType
    schema = StructType().add("conv_id", kind).add("place", LongType()).add("edit", StringType())
    schema = schema.add("turn", LongType())
    for name in ("fault", "from_role", "role", "text"):
        schema = schema.add(name, StringType())
    return in_arrow(with_faults(rows), _repaired(to_arrow_type(kind)), schema)


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_DIGEST = [*_COUNTS, "audit", "repaired_sha256"]


class _Digest:
    """What the query reports of one conversation, from its edits in order."""

    def __init__(self):
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.letters: list[str] = []
        self.sha = hashlib.sha256()
        self.low = self.high = self.initial = None
        self.turns, self.some = 0, False

    def add(self, edit, turn, fault, from_role, role, text) -> None:
        self.letters.append(edit)
        self.counts["cost"] += COST[edit]
        if edit != INSERT:
            if fault:
                self.counts[fault] += 1
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high = turn
                self.turns += 1
            if self.initial is not None and self.initial + from_role[:1] not in ("su", "ua", "au"):
                self.counts["illegal"] += 1
            self.initial = from_role[:1]
        if edit != DELETE:
            self.counts["cost"] += fault == "truncated"
            self.sha.update((b"\n" if self.some else b"") + f"{role}:{text}".encode())
            self.some = True

    def row(self) -> tuple:
        if self.turns:
            self.counts["gaps"] = self.high - self.low + 1 - self.turns
        return (*self.counts.values(), "".join(self.letters), self.sha.hexdigest())


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    ids: list[pa.Array] = []

    def taken() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in list(zip(*done))[: len(_COUNTS)]]
        columns += [pa.array(c, pa.string()) for c in list(zip(*done))[len(_COUNTS) :]]
        batch = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns], names=["conv_id", *_DIGEST])
        done.clear()
        ids.clear()
        return batch

    digest, conv, expected = None, None, 0
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in range(1, 8))))
        for at, (place, *edit) in enumerate(rows):
            if place == 0:
                if digest is not None:
                    ids.append(conv)
                    done.append(digest.row())
                digest, conv, expected = _Digest(), batch.column(0).slice(at, 1), 0
            if place != expected:
                raise RuntimeError("the edits of a conversation are not in order")
            expected += 1
            digest.add(*edit)
        if len(done) >= _BATCH:
            yield taken()
    if digest is not None:
        ids.append(conv)
        done.append(digest.row())
        yield taken()


def damaged(rows: DataFrame) -> DataFrame:
    """The conversations with the faults that the query looks for, by crc32 of ``conv_id:turn``:
    of 20 values, 0 drops a row, 1 empties its text, 2 takes the ends of its sentences, 3
    repeats it, 4 makes its role user. Nulls are one blank."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = (
        F.when(fault == 1, "")
        .when(fault == 2, F.translate(shown("text"), ENDS, ""))
        .otherwise(shown("text"))
    )
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        rows.where(fault != 0)
        .withColumn("__copy", F.explode(copies))
        .select(
            "conv_id",
            "turn",
            F.when(fault == 4, "user").otherwise(shown("role")).alias("role"),
            text.alias("text"),
        )
    )


def op12_viterbi(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    edits = repair_conversations(damaged(rows.select("conv_id", "turn", "role", "text")))
    kind = rows.schema["conv_id"].dataType
    schema = StructType().add("conv_id", kind)
    for name in _DIGEST:
        schema = schema.add(name, LongType() if name in _COUNTS else StringType())
    found = in_arrow(edits, _digested, schema).withColumnRenamed("conv_id", "__id")
    every = rows.select("conv_id").distinct()
    nothing = {**dict.fromkeys(_COUNTS, 0), "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("__id")), "left")
    return joined.select(
        "conv_id",
        *[F.coalesce(F.col(c), F.lit(v).cast(schema[c].dataType)).alias(c) for c, v in nothing.items()],
    )


def _least(*ways: str) -> str:
    """The cheapest way, then the first in ASCII order: ways are costs of ten digits and edits."""
    return f"least({', '.join(ways)})"


def _edit(way: str, cost: str, letter: str) -> str:
    return f"lpad((left({way}, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({way}, 11) || '{letter}'"


def _op12_sql() -> str:
    """Viterbi over the rows of all conversations at once, a step per row number."""
    drop = {s: f"CASE WHEN {s} IS NOT NULL THEN {_edit(s, '3', 'D')} END" for s in "tsua"}

    def stay(way: str, initial: str) -> str:
        kept = f"CASE WHEN r.initial = '{initial}' THEN {_edit(way, 'r.late', 'K')} END"
        return kept

    def rerole(way: str) -> str:
        return _edit(way, "2 + r.late", "R")

    sound = "r.fault NOT IN ('blank', 'duplicate')"
    to_user = _least(*[w for x in "tsa" for w in (stay(x, "u"), rerole(x))])
    to_answer = _least(stay("u", "a"), rerole("u"))
    inserted = _least("u", *[_edit(x, "2", "I") for x in "tsa"])
    step = f"""
      SELECT r.conv, r.i, {drop['t']} AS t,
        {_least(drop['s'], f"CASE WHEN {sound} THEN {stay('t', 's')} END")} AS s,
        {_least(drop['u'], f"CASE WHEN {sound} THEN {to_user} END")} AS u0,
        {_least(drop['a'], f"CASE WHEN {sound} THEN {to_answer} END")} AS a0
      FROM walk w JOIN faulty r ON r.conv = w.conv AND r.i = w.i + 1"""
    close = f"""SELECT conv, i, t, s, u, {_least('a', _edit('u', '2', 'I'))} AS a
      FROM (SELECT conv, i, t, s, {inserted} AS u, a FROM (SELECT conv, i, t, s, u0 AS u, a0 AS a FROM ({{}})))"""
    start = "SELECT DISTINCT conv, 0::BIGINT AS i, lpad('', 10, '0') AS t, NULL::VARCHAR AS s, NULL::VARCHAR AS u0, NULL::VARCHAR AS a0 FROM faulty"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH RECURSIVE given AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role,
    coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), hashed AS (
  SELECT *, {crc32_sql("name")} % 20 AS h FROM given
), broken AS (
  SELECT conv, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, range(2) c(copy) WHERE h <> 0 AND (copy = 0 OR h = 3)
), known AS (
  SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST) AS seen
  FROM broken
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, seen) AS i,
    right(rtrim(text, {blanks}), 1) AS last
  FROM known
), faulty AS (
  SELECT conv, i, turn, role, text, left(role, 1) AS initial,
    CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
      WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    CASE WHEN last <> '' AND seen = 1 AND last NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS late
  FROM placed
), walk AS (
  {close.format(start)}
  UNION ALL
  {close.format(step)}
), ended AS (
  SELECT conv, {_least('t', 'a')} AS way FROM (
    SELECT *, row_number() OVER (PARTITION BY conv ORDER BY i DESC) AS back FROM walk) WHERE back = 1
), letters AS (
  SELECT conv, k, substr(way, 10 + k, 1) AS letter
  FROM (SELECT conv, way, unnest(range(1, length(way) - 9)) AS k FROM ended)
), numbered AS (
  SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER before AS i,
    count(*) FILTER (WHERE letter <> 'D') OVER before AS nth
  FROM letters WINDOW before AS (PARTITION BY conv ORDER BY k ROWS UNBOUNDED PRECEDING)
), turned AS (
  SELECT n.conv, k, letter, nth, coalesce(f.text, '') AS text, f.role, f.initial
  FROM numbered n LEFT JOIN faulty f ON letter <> 'I' AND f.conv = n.conv AND f.i = n.i
  WHERE letter <> 'D'
), led AS (
  SELECT conv, coalesce(max(initial) FILTER (WHERE nth = 1 AND letter = 'K'), '') = 's' AS lead FROM turned GROUP BY conv
), spoken AS (
  SELECT t.conv, k, CASE WHEN letter = 'K' THEN role
      WHEN (nth - CASE WHEN lead THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
      || ':' || text AS line
  FROM turned t JOIN led USING (conv)
), joined AS (
  SELECT conv, string_agg(line, chr(10) ORDER BY k) AS whole FROM spoken GROUP BY conv
), pairs AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair FROM faulty
), facts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM pairs GROUP BY conv
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(left(way, 10)::BIGINT, 0) AS cost,
  coalesce(substr(way, 11), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv FROM conversations) c
LEFT JOIN facts USING (conv) LEFT JOIN ended USING (conv) LEFT JOIN joined USING (conv)
"""


OP12_SQL = _op12_sql()
