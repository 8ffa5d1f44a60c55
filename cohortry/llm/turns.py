"""Repair of the turn structure of conversations by alignment with an alternating target.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles.  Its rows are aligned, in the way of Wagner and
Fischer, with the target string of each feasible length; one table over the targets' common endings serves them all.  The
table is kept to Ukkonen's band: the diagonals that an alignment no dearer than the incumbent can reach.  Of the cheapest
targets' backtraced edits (the audits) the least in ASCII order wins.

A conversation of any length is cut into segments.  Of a segment, the cheapest edits between each state before it and
each state after it are kept; a chain over the segments chooses the states, and the edits are played back over the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortry.llm.scratch import Scratch

SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
FINE, MUST_GO, CUT_SHORT = 0, 1, 2  # kinds of rows
START, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired rows end with so far
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}  # inserts that complete the structure
ROLES = {"u": "user", "a": "assistant"}
NEVER = 1 << 60
SEGMENT = 64  # rows
SEGMENT_BYTES = 4 << 20
HEAD = 64  # characters of a text that order rows of the same turn and role


# -- alignment ------------------------------------------------------------------------------------------------------
def expected(state: int) -> str:
    return "a" if state == USER else "u"


def after(char: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}[char]


class Alignment:
    """Rows (initials and kinds) against the last j characters of the alternating string that ends with ``end``.

    ``cost(i, j)``: of aligning the rows from i on with these characters; exact wherever it is at most ``budget``.
    Without ``trailing`` no insert may follow the last row.
    """

    def __init__(self, initials: list[str], kinds: list[int], end: str, budget: int, trailing: bool):
        self.initials, self.kinds, self.end = initials, kinds, end
        other = "a" if end == "u" else "u"
        self.chars = (other, end)  # of the j-th character from the end, by parity
        n = len(initials)
        free = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            free[i] = free[i + 1] + (kinds[i] != MUST_GO)
        # Each row that must go costs a delete, each truncated one at least its surcharge; the rest of the budget is the band.
        left = budget - DELETE * (n - free[0])
        slack = left - TRUNCATED * sum(k == CUT_SHORT for k in kinds)
        more, fewer = max(0, slack // INSERT), max(0, min(slack, left // DELETE))
        self.low = [max(0, f - fewer) for f in free]
        self.rows = [[NEVER] * (f + more - low + 1) for f, low in zip(free, self.low)]
        last = self.rows[n]
        for j in range(len(last) if trailing else 1):
            last[j] = INSERT * j
        for i in range(n - 1, -1, -1):
            mine, low, costs = self.rows[i], self.low[i], [self.take(i, 0), self.take(i, 1)]
            for j in range(low, low + len(mine)):
                best = self.cost(i + 1, j) + DELETE
                if j:
                    best = min(best, self.cost(i + 1, j - 1) + costs[j % 2])
                    if j > low:
                        best = min(best, mine[j - 1 - low] + INSERT)
                mine[j - low] = min(best, NEVER)

    def cost(self, i: int, j: int) -> int:
        at = j - self.low[i]
        return self.rows[i][at] if 0 <= at < len(self.rows[i]) else NEVER

    def take(self, i: int, parity: int) -> int:
        """The cost of a row as a character of that parity."""
        if self.kinds[i] == MUST_GO:
            return NEVER
        return (KEEP if self.initials[i] == self.chars[parity] else REROLE) + (TRUNCATED if self.kinds[i] == CUT_SHORT else 0)

    def audit(self, i: int, j: int) -> str:
        """The least of the cheapest edits in ASCII order: D, I, K, R."""
        out, n = [], len(self.initials)
        while i < n or j:
            here = self.cost(i, j)
            if i < n and self.cost(i + 1, j) + DELETE == here:
                out.append("D")
                i += 1
            elif j and self.cost(i, j - 1) + INSERT == here:
                out.append("I")
                j -= 1
            else:
                out.append("K" if self.initials[i] == self.chars[j % 2] else "R")
                i, j = i + 1, j - 1
        return "".join(out)

    def best(self, state: int) -> tuple[int, str]:
        """Cost and audit from ``state`` to the end character, over all feasible lengths of the target."""
        n, found = len(self.initials), []
        same = after(self.end) == state  # then nothing need be written
        for j in range(self.low[0], self.low[0] + len(self.rows[0])):
            if j and self.chars[j % 2] == expected(state) or not j and same:
                found.append((self.cost(0, j), 0, j))
        if state == START:  # a system row may come first
            for i in range(n):
                if self.initials[i] == "s" and self.kinds[i] != MUST_GO:
                    before = DELETE * i + (TRUNCATED if self.kinds[i] == CUT_SHORT else 0)
                    for j in range(max(1, self.low[i + 1]), self.low[i + 1] + len(self.rows[i + 1])):
                        if self.chars[j % 2] == "u":
                            found.append((before + self.cost(i + 1, j), i + 1, j))
        least = min((c for c, _, _ in found), default=NEVER)
        if least >= NEVER:
            return NEVER, ""
        return least, min("D" * (i - 1) + "K" * (i > 0) + self.audit(i, j) for c, i, j in found if c == least)


def cheapest(initials: list[str], kinds: list[int], wanted: list[tuple[int, int]], trailing: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """For each pair of states, cost and audit; pairs that cannot be are left out."""
    n = len(initials)
    out: dict[tuple[int, int], tuple[int, str]] = {}
    budget = DELETE * sum(k == MUST_GO for k in kinds) + TRUNCATED * sum(k == CUT_SHORT for k in kinds) + INSERT
    for char in "ua":
        pairs = [p for p in wanted if p[1] == after(char)]
        while pairs:
            table = Alignment(initials, kinds, char, budget, trailing)
            found = {p: table.best(p[0]) for p in pairs}
            most = max(c for c, _ in found.values())
            if most <= budget or budget > 8 * n + 16:
                out |= {p: f for p, f in found.items() if f[0] < NEVER}
                break
            # What was found can be done, so it is the incumbent; where nothing was found the band is doubled.
            budget = most if most < NEVER else 2 * budget
    for same in ((START, START), (SYSTEM, SYSTEM)):
        if same in wanted:
            out[same] = (DELETE * n, "D" * n)
    if (START, SYSTEM) in wanted:
        alone = [(TRUNCATED * (kinds[i] == CUT_SHORT), "D" * i + "K" + "D" * (n - 1 - i)) for i in range(n) if initials[i] == "s" and kinds[i] != MUST_GO]
        if alone:
            cost, audit = min(alone)
            out[START, SYSTEM] = (cost + DELETE * (n - 1), audit)
    return out


ANY = [(s, t) for s in range(4) for t in range(4)]


def whole(initials: list[str], kinds: list[int]) -> tuple[int, str]:
    """Cost and audit of a conversation."""
    return min(cheapest(initials, kinds, [(START, START), (START, ASSISTANT)], True).values(), default=(0, ""))


def replay(audit: str, rows: list[tuple[str, str]], state: int) -> tuple[list[str], int]:
    """The repaired lines of ``rows`` (role, text), and the state after them."""
    lines, at = [], 0
    for edit in audit:
        if edit == "I":
            role, text = ROLES[expected(state)], ""
        else:
            role, text = rows[at]
            at += 1
        if edit == "D":
            continue
        if edit == "R":
            role = ROLES[expected(state)]
        lines.append(f"{role}:{text}")
        state = after(role[:1])
    return lines, state


# -- rows -------------------------------------------------------------------------------------------------------------
def damage(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id, turn, role, text, dropped, uid``: some rows dropped, emptied, cut, repeated or given another role."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled(id_col), F.lit(":"), filled(turn_col)).cast("binary")) % 20
    role, text = filled(role_col), filled(text_col)
    rows = conversations.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"),
        F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.withColumn("copy", F.explode("copies")).select("conv_id", "turn", "role", "text", "dropped", (F.col("row") * 2 + F.col("copy")).alias("uid"))


def marked(rows: DataFrame) -> DataFrame:
    """All rows and, before each row whose role and text the conversation has had earlier, a mark with the same keys."""
    inner = F.rtrim(F.col("text"), F.lit(SPACE))
    kind = F.when(inner == "", MUST_GO).when(F.right(inner, F.lit(1)).isin(*".!?"), FINE).otherwise(CUT_SHORT)
    rows = rows.select("*", kind.alias("kind"), F.left("text", F.lit(HEAD)).alias("head"))
    hashes = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("turn"), "text").alias("h2")]
    narrow = rows.where(~F.col("dropped") & (F.col("kind") != MUST_GO)).select("conv_id", "turn", "role", "head", "uid", *hashes)
    same = ["conv_id", "role", "h1", "h2"]
    firsts = narrow.groupBy(*same).agg(F.min(F.struct("turn", "uid")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(*[F.col(c).alias(f"f_{c}") for c in same], F.col("first.uid").alias("first"))
    again = narrow.join(firsts, [narrow[c].eqNullSafe(firsts[f"f_{c}"]) for c in same]).where("uid <> first")
    marks = again.select("conv_id", "turn", "role", "head", "uid", F.lit(0).alias("tag"))
    return rows.withColumn("tag", F.lit(1)).unionByName(marks, allowMissingColumns=True)


class Segment:
    """Rows of one conversation, in order, none dropped."""

    def __init__(self, conv_id: int | None, opened: bool):
        self.conv_id, self.opened = conv_id, opened  # opened: rows of it may stand before
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.kinds: list[int] = []
        self.faults = [0, 0, 0]
        self.turns: list[int | None] = []
        self.size = 0

    def add(self, turn: int | None, role: str, text: str, kind: int, again: bool) -> None:
        fault = 0 if kind == MUST_GO else 1 if again else 2 if kind == CUT_SHORT else None
        if fault is not None:
            self.faults[fault] += 1
        self.roles.append(role)
        self.texts.append(text)
        self.kinds.append(MUST_GO if again else kind)
        self.turns.append(turn)
        self.size += len(text)

    def facts(self) -> dict:
        initials = [r[:1] for r in self.roles]
        known = sorted({t for t in self.turns if t is not None})
        return {
            "blank": self.faults[0],
            "duplicate": self.faults[1],
            "truncated": self.faults[2],
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "first_initial": initials[0] if initials else None,
            "last_initial": initials[-1] if initials else None,
            "first_turn": known[0] if known else None,
            "last_turn": known[-1] if known else None,
            "turns": len(known),
        }

    def closed(self) -> dict:
        cost, audit = whole([r[:1] for r in self.roles], self.kinds)
        lines, _ = replay(audit, list(zip(self.roles, self.texts)), START)
        return self.facts() | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}

    def part(self) -> dict:
        found = cheapest([r[:1] for r in self.roles], self.kinds, ANY, False) if self.roles else {(s, s): (0, "") for s in range(4)}
        order = sorted(found, key=lambda p: (p[0], found[p][1]))
        ways = {"starts": [s for s, _ in order], "ends": [t for _, t in order], "costs": [found[p][0] for p in order], "audits": [found[p][1] for p in order]}
        return self.facts() | ways | {"roles": self.roles, "texts": self.texts}


FACTS = "blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, first_turn long, last_turn long, turns long"
WAYS = "starts array<int>, ends array<int>, costs array<long>, audits array<string>, roles array<string>, texts array<string>"
SEGMENTS = f"conv_id long, part int, k long, {FACTS}, cost long, audit string, repaired_sha256 string, {WAYS}"
ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def batch_of(rows: list[dict], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], ARROW[t]) for n, t in zip(names, kinds)], list(names))


def segments(rows: DataFrame) -> DataFrame:
    """Repaired conversations, and the segments of those that are long or reach the end of their task's range.

    Rows come in ranges of (conversation, turn); a conversation with very many rows lies in several ranges.
    """
    keys = ["conv_id", F.asc_nulls_first("turn"), "role", "head", "uid"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "tag")
    columns = ["conv_id", "turn", "role", "text", "dropped", "kind", "tag"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, out = TaskContext.get().partitionId(), 0, []
        now: Segment | None = None
        again = False

        def close(last: bool) -> None:
            nonlocal k
            done = not now.opened and not last
            out.append({"conv_id": now.conv_id, "part": part, "k": k} | (now.closed() if done else now.part()))
            k += 1

        for batch in batches:
            for conv, turn, role, text, dropped, kind, tag in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if now is None or conv != now.conv_id:
                    first = now is None
                    if now is not None:
                        close(False)
                    now, again = Segment(conv, first), False
                elif len(now.roles) >= SEGMENT or now.size >= SEGMENT_BYTES:
                    now.opened = True
                    close(False)
                    now = Segment(conv, True)
                if not tag:
                    again = True
                elif not dropped:
                    now.add(turn, role, text, kind, again)
                    again = False
                if len(out) >= 512:
                    yield batch_of(out, SEGMENTS)
                    out = []
        if now is not None:
            close(True)
        if out:
            yield batch_of(out, SEGMENTS)

    return ordered.select(*columns).mapInArrow(run, SEGMENTS)


def chain(table: pa.Table) -> pa.Table:
    """The states between the segments of one conversation, and its totals (in the row of its last segment).

    A segment counts about a dozen small numbers here, less than its part of the audit.
    """
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["k"]))
    togo = {s: INSERT * len(c) for s, c in CLOSING.items()}
    later = [togo]
    for r in reversed(rows):
        before = dict.fromkeys(range(4), NEVER)
        for s, t, c in zip(r["starts"], r["ends"], r["costs"]):
            before[s] = min(before[s], c + togo[t])
        togo = before
        later.append(togo)
    later.reverse()
    state, out, live = START, [], [r for r in rows if r["first_initial"] is not None]
    for r, here, then in zip(rows, later, later[1:]):
        # Ways from a state stand in the order of their audits.
        way = next(i for i, (s, t, c) in enumerate(zip(r["starts"], r["ends"], r["costs"])) if s == state and c + then[t] == here[state])
        out.append({"conv_id": r["conv_id"], "part": r["part"], "k": r["k"], "state": state, "way": way})
        state = r["ends"][way]
    timed = [r for r in rows if r["turns"]]
    seams = sum(a["last_initial"] + b["first_initial"] not in ("su", "ua", "au") for a, b in zip(live, live[1:]))
    split = sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
    totals = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out[-1] |= totals | {
        "closing": CLOSING[state],
        "cost": later[0][START],
        "illegal": totals["illegal"] + seams,
        "turns": totals["turns"] - split,
        "first_turn": timed[0]["first_turn"] if timed else None,
        "last_turn": timed[-1]["last_turn"] if timed else None,
    }
    return pa.Table.from_batches([batch_of(out, CHOSEN)])


CHOSEN = "conv_id long, part int, k long, state int, way int, closing string, cost long, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, turns long"
TOTALS = "blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, turns long, cost long"
REPAIRED = f"conv_id long, {TOTALS}, audit string, repaired_sha256 string"


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from their segments, which come in order; rows are hashed as they pass."""
    sha, audit, first = hashlib.sha256(), [], True
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            edits = r["chosen"] + (r["closing"] or "")
            lines, _ = replay(edits, list(zip(r["roles"], r["texts"])), r["state"])
            if lines:
                sha.update((("" if first else "\n") + "\n".join(lines)).encode())
                first = False
            audit.append(edits)
            if r["closing"] is not None:
                out.append(r | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
                sha, audit, first = hashlib.sha256(), [], True
        if out:
            yield batch_of(out, REPAIRED)


def repair(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired text of each conversation.

    ``rows``: ``conv_id`` (long), ``turn``, ``role``, ``text`` (none null but the first two), ``dropped`` (the row is not
    there, its conversation is) and ``uid`` (unique).  Returns ``conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256``.

    Rows of a conversation stand in the order of turn (nulls first), role, the text's first characters, ``uid``.  A conversation of
    any size is worked on in segments by many tasks; only the hash of its text, a chain by its nature, runs over its
    segments in one task, row by row in constant memory.  The audit is one text, a letter per edit.
    """
    made = scratch.keep(segments(marked(rows)), "segments")
    whole_ones = made.where("audit is not null")
    pieces = made.where("audit is null")
    narrow = pieces.drop("audits", "roles", "texts", "audit", "repaired_sha256", "cost")
    chosen = scratch.keep(narrow.groupBy("conv_id").applyInArrow(chain, CHOSEN), "chosen")
    wide = pieces.select("part", "k", "audits", "roles", "texts").join(chosen, ["part", "k"])
    wide = wide.withColumn("chosen", F.get("audits", F.col("way"))).drop("audits", "way")
    wide = wide.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "part", "k")
    long_ones = wide.mapInArrow(joined, REPAIRED)
    columns = [f.split()[0] for f in REPAIRED.split(", ")]
    out = whole_ones.select(*columns).unionByName(long_ones)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    return out.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged_and_repaired(conversations: DataFrame, scratch: Scratch, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``repair`` of rows that were damaged by a hash of conversation and turn.

    Null roles and texts count as one space; a null id is a conversation of its own.  Every conversation is returned,
    those that lost all rows with zeros, an empty audit and the hash of an empty text.  Repeated rows are duplicates of
    each other.  Other columns are not read; an empty table gives no rows.
    """
    rows = damage(conversations.withColumn(id_col, F.col(id_col).cast("long")), id_col, turn_col, role_col, text_col)
    # Row numbers are fixed once written, whatever is computed again later.
    return repair(scratch.keep(rows, "rows"), scratch)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return damaged_and_repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"), Scratch(spark, "turns"))


QUERIES = {"op11_turn_repair": query}
ORACLES = {
    "op11_turn_repair": r"""
with recursive bits(i, k, c) as (
  select i, 0, i from range(256) r(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
crc as (select list(c order by i) as t from bits where k = 8),
keyed as (
  select row_number() over () as rid, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ascii(x) as bigint)) as bytes
  from conversations),
hashed as (
  select keyed.*, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as kind from keyed, crc),
damaged as (
  select rid, conv_id, turn, case when kind = 4 then 'user' else role end as role, unnest(case when kind = 3 then [0, 1] else [0] end) as copy,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from hashed where kind <> 0),
placed as (
  select *, substr(role, 1, 1) as initial, row_number() over (partition by conv_id order by turn nulls first, role, text, rid, copy) as pos,
    not regexp_matches(text, '[^\x20\x09-\x0D]') as blank,
    row_number() over (partition by conv_id, role, text order by turn nulls first, rid, copy) > 1 as again,
    not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as unended
  from damaged),
seen as (
  select *, blank or again as must_go, not blank and not again and unended as cut_short,
    lag(initial) over (partition by conv_id order by pos) || initial as two from placed),
facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
    count(*) filter (again and not blank) as duplicate, count(*) filter (cut_short) as truncated,
    count(*) filter (two not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from seen group by conv_id),
inserts(state, upto, audit, lines) as (
  values ('', '', '', []::varchar[]), ('s', 's', '', []), ('u', 'u', '', []), ('a', 'a', '', []),
    ('', 'u', 'I', ['user:']), ('s', 'u', 'I', ['user:']), ('a', 'u', 'I', ['user:']), ('u', 'a', 'I', ['assistant:']),
    ('', 'a', 'II', ['user:', 'assistant:']), ('s', 'a', 'II', ['user:', 'assistant:'])),
edits(upto, next, role) as (values ('', 'u', 'user'), ('s', 'u', 'user'), ('a', 'u', 'user'), ('u', 'a', 'assistant')),
walk(conv_id, pos, state, best) as (
  select distinct conv_id, cast(0 as bigint), '', {'cost': cast(0 as bigint), 'audit': '', 'lines': []::varchar[]} from conversations
  union all
  select conv_id, pos, state, min(best) from (
    select w.conv_id, r.pos, e.state, {
      'cost': cast(w.best.cost + 3 * length(i.audit) + e.cost as bigint), 'audit': w.best.audit || i.audit || e.edit,
      'lines': w.best.lines || i.lines || e.lines} as best
    from walk w join seen r on r.conv_id is not distinct from w.conv_id and r.pos = w.pos + 1
    join inserts i on i.state = w.state
    join edits x on x.upto = i.upto,
    lateral (
      select i.upto as state, 4 as cost, 'D' as edit, []::varchar[] as lines
      union all select x.next, 3 + 3 * cast(r.cut_short as integer), 'R', [x.role || ':' || r.text] where not r.must_go and r.initial <> x.next
      union all select r.initial, 3 * cast(r.cut_short as integer), 'K', [r.role || ':' || r.text]
        where not r.must_go and (r.initial = x.next or r.initial = 's' and i.upto = '')) e) steps
  group by conv_id, pos, state),
ends as (
  select w.conv_id, min({'cost': w.best.cost + 3 * length(i.audit), 'audit': w.best.audit || i.audit, 'lines': w.best.lines || i.lines}) as best
  from walk w left join facts f on f.conv_id is not distinct from w.conv_id join inserts i on i.state = w.state
  where w.pos = coalesce(f.n, 0) and (i.upto = 'a' or i.upto = '') group by w.conv_id)
select e.conv_id, coalesce(f.gaps, 0) as gaps, coalesce(f.blank, 0) as blank, coalesce(f.duplicate, 0) as duplicate,
  coalesce(f.truncated, 0) as truncated, coalesce(f.illegal, 0) as illegal, cast(e.best.cost as bigint) as cost, e.best.audit as audit,
  sha256(array_to_string(e.best.lines, chr(10))) as repaired_sha256
from ends e left join facts f on f.conv_id is not distinct from e.conv_id"""
}
