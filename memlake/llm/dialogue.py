"""Repair of conversation structure: the cheapest edits that turn damaged turns into ``(s?(ua)+)?`` (system, then user and assistant).

A conversation is decoded by a Viterbi pass over four states.  The survivors' edits are a tree of backpointers with reference counts:
a path that loses its last survivor is freed, and once the survivors share an ancestor the edits before it are final and leave the
tree.  Ties are settled by comparing whole unresolved paths, found by jump pointers in steps that grow as the logarithm of their
length.  Texts are never held: they are read row by row, and each survivor carries a running digest of its own repaired text.

Spark deals conversations to tasks and sorts their rows (spilling where needed); a task holds one batch, the tree's unresolved edits
and the audits of a batch.  One digest over a whole conversation is sequential by its nature, so a conversation's rows pass through
one task, as a stream; ``repaired`` fetches texts by row instead, so there long conversations are spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.merkle import _CRC_SQL as CRC_SQL
from memlake.llm.registry import query, table
from memlake.llm.words import BATCH_ROWS, small

#: Costs and initials of the edits; fixed by the task.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, OPENED, ASKED, ANSWERED = range(4)
#: The role that each state takes next (START also takes a system turn), and the state after it.
_NEXT = {START: ("user", ASKED), OPENED: ("user", ASKED), ANSWERED: ("user", ASKED), ASKED: ("assistant", ANSWERED)}
#: _BEHIND[p][q]: whatever follows, going on from p costs at most this much more than going on from q.  From q a system turn may be
#: kept that p must delete, from p a turn may have to be inserted to be where q is, and a lone system turn needs a pair after it.
_BEHIND = [[0, 0, INSERT, 0], [2 * INSERT, 0, INSERT, 2 * INSERT], [INSERT + DELETE, INSERT, 0, INSERT], [DELETE, 0, INSERT, 0]]


class Tree:
    """Edits as a tree of backpointers; node 0 is unused, so that the sum of a node's children is 0 only without children."""

    def __init__(self) -> None:
        self.parent, self.jump, self.jump_depth, self.depth, self.refs, self.children, self.edit = [0, 1], [0, 1], [0, 0], [0, 0], [0, 0], [0, 0], ["", ""]
        self.free: list[int] = []
        self.root = 1

    def add(self, parent: int, edit: str) -> int:
        """A new child, held once."""
        depth, jump_depth = self.depth, self.jump_depth
        at, above = depth[parent] + 1, jump_depth[parent]
        jump, jump_at = parent, at - 1
        if above >= depth[self.root]:  # else the jump's target has left the tree
            further = self.jump[parent]
            if at - 1 - above == above - jump_depth[further] and jump_depth[further] >= depth[self.root]:
                jump, jump_at = self.jump[further], jump_depth[further]
        if self.free:
            node = self.free.pop()
            self.parent[node], self.jump[node], jump_depth[node], depth[node], self.refs[node], self.children[node], self.edit[node] = parent, jump, jump_at, at, 1, 0, edit
        else:
            node = len(self.parent)
            for column, value in ((self.parent, parent), (self.jump, jump), (jump_depth, jump_at), (depth, at), (self.refs, 1), (self.children, 0), (self.edit, edit)):
                column.append(value)
        self.refs[parent] += 1
        self.children[parent] += node
        return node

    def release(self, node: int) -> None:
        """Gives up one hold; what nothing holds any more is freed, up to the first node that is still needed."""
        self.refs[node] -= 1
        while self.refs[node] == 0 and node != self.root:
            above = self.parent[node]
            self.free.append(node)
            self.children[above] -= node
            self.refs[above] -= 1
            node = above

    def settled(self) -> Iterator[str]:
        """The edits that all survivors share; they leave the tree."""
        while self.refs[self.root] == 1 and self.children[self.root]:
            child = self.children[self.root]
            self.free.append(self.root)
            self.root = child
            yield self.edit[child]

    def path(self, node: int) -> list[str]:
        """The edits from the root to ``node``."""
        edits = []
        while node != self.root:
            edits.append(self.edit[node])
            node = self.parent[node]
        return edits[::-1]

    def _lift(self, node: int, depth: int) -> int:
        """The ancestor at ``depth``."""
        low = self.depth[self.root]
        while self.depth[node] > depth:
            node = self.jump[node] if self.jump_depth[node] >= max(depth, low) else self.parent[node]
        return node

    def less(self, a: int, then_a: str, b: int, then_b: str) -> bool:
        """Whether a's edits and ``then_a`` come before b's and ``then_b`` in ASCII order."""
        if a == b:
            return then_a < then_b
        depth_a, depth_b = self.depth[a], self.depth[b]
        if depth_a > depth_b:
            a = self._lift(a, depth_b + 1)
            if self.parent[a] == b:
                return self.edit[a] < then_b
            a = self.parent[a]
        elif depth_b > depth_a:
            b = self._lift(b, depth_a + 1)
            if self.parent[b] == a:
                return then_a <= self.edit[b]
            b = self.parent[b]
        low = self.depth[self.root]
        while self.parent[a] != self.parent[b]:
            if self.jump_depth[a] == self.jump_depth[b] >= low and self.jump[a] != self.jump[b]:
                a, b = self.jump[a], self.jump[b]
            else:
                a, b = self.parent[a], self.parent[b]
        return self.edit[a] < self.edit[b]


class Decoder:
    """The cheapest edits of one conversation, ASCII-least among equals, from its turns one by one.

    ``survivors[state]`` is (cost, node of the tree, digest of the repaired text, whether that has a line).
    """

    def __init__(self) -> None:
        self.tree = Tree()
        self.tree.refs[1] = 1
        self.survivors: list[tuple | None] = [(0, 1, hashlib.sha256(), False), None, None, None]
        self._insert()

    def _line(self, digest, has_line: bool, role: str, text: bytes):
        digest = digest.copy()
        digest.update(f"{chr(10) if has_line else ''}{role}:".encode() + text)
        return digest

    def _insert(self) -> None:
        """Inserted turns, wherever one makes a state cheaper to reach; two in a row lead from START or OPENED to ANSWERED."""
        tree, survivors = self.tree, self.survivors
        for target, sources in ((ASKED, (START, OPENED, ANSWERED)), (ANSWERED, (ASKED,))):
            best = None if survivors[target] is None else (survivors[target][0], survivors[target][1], "", None)
            for state in sources:
                if survivors[state] is not None:
                    cost, node = survivors[state][0] + INSERT, survivors[state][1]
                    if best is None or cost < best[0] or cost == best[0] and tree.less(node, "I", best[1], best[2]):
                        best = (cost, node, "I", state)
            if best is not None and best[3] is not None:
                _, _, digest, has_line = survivors[best[3]]
                old, survivors[target] = survivors[target], (best[0], tree.add(best[1], "I"), self._line(digest, has_line, _NEXT[best[3]][0], b""), True)
                if old is not None:
                    tree.release(old[1])
        for q in range(4):
            mine = survivors[q]
            if mine is not None and any(x is not None and x[0] + _BEHIND[p][q] < mine[0] for p, x in enumerate(survivors)):
                survivors[q] = None
                tree.release(mine[1])

    def turn(self, role: str, fault: str, text: bytes) -> Iterator[str]:
        """Takes the next turn; gives the edits that are final now."""
        tree, old = self.tree, self.survivors
        best: list[tuple | None] = [None] * 4

        def offer(target: int, cost: int, state: int, edit: str, as_role: str | None) -> None:
            now, node = best[target], old[state][1]
            if now is None or cost < now[0] or cost == now[0] and tree.less(node, edit, now[4], now[2]):
                best[target] = (cost, state, edit, as_role, node)

        initial = role[:1]
        for state in range(4):
            if old[state] is None:
                continue
            cost = old[state][0]
            offer(state, cost + DELETE, state, "D", None)
            if fault not in ("blank", "duplicate"):
                cost += TRUNCATED if fault == "truncated" else 0
                wanted, target = _NEXT[state]
                if initial == wanted[0]:
                    offer(target, cost + KEEP, state, "K", role)
                else:
                    offer(target, cost + REROLE, state, "R", wanted)
                if state == START and initial == "s":
                    offer(OPENED, cost + KEEP, state, "K", role)
        new: list[tuple | None] = [None] * 4
        for target, chosen in enumerate(best):
            if chosen is not None:
                cost, state, edit, as_role, node = chosen
                digest, has_line = old[state][2:]
                if as_role is not None:
                    digest, has_line = self._line(digest, has_line, as_role, text), True
                new[target] = (cost, tree.add(node, edit), digest, has_line)
        for survivor in old:
            if survivor is not None:
                tree.release(survivor[1])
        self.survivors = new
        self._insert()
        return tree.settled()

    def end(self) -> tuple[int, list[str], str]:
        """Cost, the edits that were not final yet, and the digest of the repaired text."""
        a, b = self.survivors[START], self.survivors[ANSWERED]
        first = b is None or a is not None and (a[0] < b[0] or a[0] == b[0] and self.tree.less(a[1], "", b[1], ""))
        cost, node, digest, _ = a if first else b
        return cost, self.tree.path(node), digest.hexdigest()


def with_faults(turns: DataFrame, lost: Column | None = None) -> DataFrame:
    """``conv_id, turn, role, text, fault, lost`` of the turns (nulls in role and text: one space), a conversation's rows together and
    in order: by turn (nulls first), ties by role and digest of the text.

    ``fault`` is the first of blank, duplicate (role and text seen earlier in the conversation), truncated, or empty.  Rows that are
    ``lost`` only name their conversation.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    plain = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.lit(False) if lost is None else F.coalesce(lost, F.lit(False))).alias("lost"))
    together = plain.withColumn("text_hash", F.sha2("text", 256)).repartition("conv_id")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_hash"), F.col("nth")]
    # The same exchange serves these windows and the final order.
    nth = F.row_number().over(Window.partitionBy("conv_id", "lost", "role", "text_hash").orderBy(F.col("turn").asc_nulls_first()))
    stripped = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = (F.when(stripped == "", F.lit("blank")).when(F.col("nth") > 1, F.lit("duplicate"))
             .when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), F.lit("truncated")).otherwise(F.lit("")))
    return together.withColumn("nth", nth).withColumn("fault", fault).sortWithinPartitions("conv_id", *order).select("conv_id", "turn", "role", "text", "fault", "lost")


def _conversations(batches: Iterator[pa.RecordBatch], kinds: list[pa.DataType]) -> Iterator[tuple]:
    """(conversation, row or None at its end), row by row; conversations follow one another.  ``kinds`` gets the type of conv_id."""
    current: tuple | None = None
    for batch in small(batches):
        kinds[:] = [batch.column(0).type]
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for conv, *row in zip(*columns):
            if current != (conv,):
                if current is not None:
                    yield current[0], None
                current = (conv,)
            yield conv, row
    if current is not None:
        yield current[0], None


def audit(turns: DataFrame, lost: Column | None = None) -> DataFrame:
    """One row for each conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``audit`` holds the initials of the cheapest edits in order (Keep, Rerole, Delete, Insert), the ASCII-least of the cheapest;
    ``repaired_sha256`` is the digest of the repaired ``role:text`` lines.  ``turns`` has conv_id, turn, role and text; other columns may
    have any names.  A null conv_id is a conversation of its own; repeated turns are duplicates, turns of equal number keep a fixed order;
    empty texts are blank; a conversation whose rows are all lost has zeros, an empty audit and the digest of nothing; texts and
    conversations of any length are taken whole; an empty table gives no rows.
    """
    rows = with_faults(turns, lost)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([rows.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in counts], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kinds: list[pa.DataType] = []

        def given(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.array(columns[0], kinds[0]), *[pa.array(c, pa.int64()) for c in columns[1:7]], *[pa.array(c, pa.string()) for c in columns[7:]]]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *counts, "audit", "repaired_sha256"])

        decoder = None
        for conv, row in _conversations(batches, kinds):
            if decoder is None:
                decoder, edits, seen, illegal = Decoder(), bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, 0
                first = last = before = None
                turns = 0
            if row is None:
                cost, rest, digest = decoder.end()
                edits += "".join(rest).encode()
                gaps = 0 if first is None else last - first + 1 - turns
                out.append((conv, gaps, seen["blank"], seen["duplicate"], seen["truncated"], illegal, cost, edits.decode(), digest))
                decoder = None
                if len(out) >= BATCH_ROWS:
                    yield given(out)
                    out = []
                continue
            turn, role, text, fault, lost = row
            if lost:
                continue
            seen[fault] += 1
            if turn is not None:
                first = turn if first is None else first
                turns += turn != last
                last = turn
            illegal += before is not None and before + role[:1] not in _LEGAL
            before = role[:1]
            for edit in decoder.turn(role, fault, text.encode()):
                edits += edit.encode()
        if out:
            yield given(out)

    return rows.mapInArrow(run, schema)


def edits(turns: DataFrame, lost: Column | None = None) -> DataFrame:
    """The edits themselves: ``conv_id, step, place, edit, role``, numbered in ``step`` from 1; ``place`` counts the conversation's turns
    in order from 1 and is null for an inserted one; ``role`` is null for a deleted one.  Cases as in ``audit``."""
    rows = with_faults(turns, lost).select("conv_id", "role", F.lit("").alias("text"), "fault", "lost")
    schema = T.StructType([rows.schema["conv_id"], T.StructField("step", T.LongType()), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kinds: list[pa.DataType] = []

        def given(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kinds[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                                               pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())], names=["conv_id", "step", "place", "edit", "role"])

        decoder = None
        for conv, row in _conversations(batches, kinds):
            if decoder is None:
                decoder, waiting, state, step, place = Decoder(), [], START, 0, 0
            final = decoder.end()[1] if row is None else decoder.turn(row[0], row[2], b"") if not row[3] else ()
            if row is not None and not row[3]:
                waiting.append(row[0])  # roles of turns whose edit is not final
            taken = 0
            for edit in final:
                step += 1
                role = None
                if edit != "I":
                    role, taken, place = waiting[taken], taken + 1, place + 1
                if edit in "IR":
                    role = _NEXT[state][0]
                out.append((conv, step, None if edit == "I" else place, edit, None if edit == "D" else role))
                if edit != "D":
                    state = OPENED if state == START and edit == "K" and role[:1] == "s" else _NEXT[state][1]
                if len(out) >= BATCH_ROWS:
                    yield given(out)
                    out = []
            del waiting[:taken]
            if row is None:
                decoder = None
        if out:
            yield given(out)

    return rows.mapInArrow(run, schema)


def repaired(turns: DataFrame, lost: Column | None = None) -> DataFrame:
    """The repaired turns: ``conv_id, step, role, text``, texts of inserted turns empty.  Texts are fetched by (conversation, place)."""
    done = edits(turns, lost).where("edit <> 'D'")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.sha2("text", 256)]
    rows = with_faults(turns, lost).where(~F.col("lost")).withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long"))
    texts = rows.select(F.col("conv_id").alias("_conv"), F.col("place").alias("_place"), "text")
    met = done.join(texts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("place") == F.col("_place")), "left")
    return met.select("conv_id", "step", "role", F.coalesce("text", F.lit("")).alias("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults by the hash of conversation and number: lost, emptied, without full stops, repeated, or all user."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    hit = (F.crc32(name.cast("binary")) % 20).cast("int")
    marked = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), hit.alias("hit"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1)))
    new_text = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    new_role = F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role"))
    return marked.select("conv_id", "turn", new_role.alias("role"), new_text.alias("text"), (F.col("hit") == 0).alias("lost"), copies.alias("copy")).drop("copy")


_ORACLE = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' ') AS name FROM conversations),
h AS (SELECT *, ({CRC_SQL.format('name')}) % 20 AS hit FROM c),
d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, (VALUES (1), (2)) v(copy) WHERE hit <> 0 AND (copy = 1 OR hit = 3)),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM d),
n AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), nth) AS seq,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM m),
f AS (SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY seq) || initial AS pair FROM n),
ins(state, target, edits, added) AS (VALUES (0, 0, '', []::varchar[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']),
  (1, 2, 'I', ['user:']), (3, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])),
step(state, edit, initial, target, price, as_role) AS (VALUES (0, 'D', NULL, 0, 2, NULL), (1, 'D', NULL, 1, 2, NULL), (2, 'D', NULL, 2, 2, NULL), (3, 'D', NULL, 3, 2, NULL),
  (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (3, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL),
  (0, 'R', NULL, 2, 1, 'user'), (1, 'R', NULL, 2, 1, 'user'), (3, 'R', NULL, 2, 1, 'user'), (2, 'R', NULL, 3, 1, 'assistant')),
w AS (
  SELECT DISTINCT conv_id, 0::bigint AS seq, 0 AS state, 0 AS cost, '' AS audit, []::varchar[] AS lines FROM c
  UNION ALL
  SELECT conv_id, seq, state, cost, audit, lines FROM (
    SELECT w.conv_id, f.seq, step.target AS state, w.cost + 5 * len(ins.edits) + step.price + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost,
      w.audit || ins.edits || edit AS audit,
      list_concat(w.lines, ins.added, CASE WHEN edit = 'D' THEN [] ELSE [coalesce(as_role, f.role) || ':' || f.text] END) AS lines,
      row_number() OVER (PARTITION BY w.conv_id, step.target ORDER BY w.cost + 5 * len(ins.edits) + step.price + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END,
        w.audit || ins.edits || edit) AS k
    FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.seq = w.seq + 1 JOIN ins ON ins.state = w.state
      JOIN step ON step.state = ins.target AND (step.initial IS NULL OR step.initial = f.initial) AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate')))
  WHERE k = 1),
size AS (SELECT conv_id, max(seq) AS seq FROM w GROUP BY conv_id),
ends AS (SELECT w.conv_id, cost + 5 * len(edits) AS cost, audit || edits AS audit, list_concat(lines, added) AS lines,
    row_number() OVER (PARTITION BY w.conv_id ORDER BY cost + 5 * len(edits), audit || edits) AS k
  FROM w JOIN size ON w.conv_id IS NOT DISTINCT FROM size.conv_id AND w.seq = size.seq JOIN ins ON ins.state = w.state WHERE target IN (0, 3)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, cast(coalesce(gaps, 0) AS bigint) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, cast(cost AS bigint) AS cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts ON e.conv_id IS NOT DISTINCT FROM counts.conv_id WHERE k = 1
"""


@query("op12_dialogue", _ORACLE)
def op12_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all ``conversations`` after planted damage."""
    return audit(damaged(table(spark, sf_dir, "conversations")), F.col("lost"))
