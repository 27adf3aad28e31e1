"""Conversation repair by deduplicated signatures.

Every row of a conversation becomes one letter for its role and fault, so a conversation is a short
string. Equal strings need equal repairs: each distinct one is solved once, by memoised recursion,
and the repairs, themselves strings with a letter for each edit, are joined back and replayed.
Texts travel once, to be replayed; the letters are made from digests.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioqc.llm.common import cut, meet, scratch, slices

VISIBLE = "[^\\x20\\x09-\\x0D]"
STOPS = ".!?"
#: Costs of a deletion, another role, an inserted row, and a truncated row that stays.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Letters of a signature: four classes of roles for each of four faults.
ROLES, FAULTS = "suax", ("", "blank", "duplicate", "truncated")
LETTERS = "ABCDEFGHIJKLMNOP"
#: Names of roles by their initial, for rows that an edit makes.
NAMES = {"u": "user", "a": "assistant"}
#: Positions that recursion goes down before it returns; longer strings are solved from their end.
STRIDE = 50

#: What is emitted so far: nothing, s, u or a; the role that may follow each, and what it leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
EMITS = {USER: "u", ASSISTANT: "a"}
FAR = 1 << 60

SOLVED = "signature string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
REPAIRED = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class Repair:
    """The cheapest edits of one signature.

    best() is the cost from a row on, given what is emitted and how many rows were just inserted.
    Of choices of equal cost the one with the smallest letter is taken; as no two choices share a
    letter, this gives the least audit. Two insertions in a row are enough: a third returns to
    where the first one was.
    """

    def __init__(self, signature: str):
        self.rows = [(ROLES[c % 4], FAULTS[c // 4]) for c in map(LETTERS.index, signature)]
        self.cost = array("q", [-1]) * (12 * (len(self.rows) + 1))
        self.letter = bytearray(len(self.cost))
        for at in range(len(self.rows), -1, -STRIDE):
            for state in range(4):
                self.best(at, state, 0)

    def choices(self, at: int, state: int, inserted: int) -> Iterator[tuple[int, str, tuple[int, int, int]]]:
        """(cost, letter, where it leads) of each edit."""
        to = NEXT[state]
        if inserted < 2:
            yield INSERT, "I", (at, to, inserted + 1)
        if at < len(self.rows):
            role, fault = self.rows[at]
            yield DELETE, "D", (at + 1, state, 0)
            if fault not in ("blank", "duplicate"):
                stays = TRUNCATED if fault else 0
                yield REROLE + stays, "R", (at + 1, to, 0)
                if role == EMITS[to]:
                    yield stays, "K", (at + 1, to, 0)
                elif role == "s" and state == START:
                    yield stays, "K", (at + 1, SYSTEM, 0)

    def best(self, at: int, state: int, inserted: int) -> int:
        slot = 12 * at + 3 * state + inserted
        if self.cost[slot] < 0:
            done = (0, "") if at == len(self.rows) and state in (START, ASSISTANT) else (FAR, "I")
            found = min([done, *((c + self.best(*to), letter) for c, letter, to in self.choices(at, state, inserted))])
            self.cost[slot], self.letter[slot] = min(found[0], FAR), ord(found[1] or "\0")
        return self.cost[slot]

    def audit(self) -> str:
        out, where = [], (0, START, 0)
        while letter := self.letter[12 * where[0] + 3 * where[1] + where[2]]:
            out.append(chr(letter))
            where = next(to for _, c, to in self.choices(*where) if c == out[-1])
        return "".join(out)

    def result(self) -> tuple[int, int, int, int, int, str]:
        """blank, duplicate, truncated, illegal, cost and audit."""
        faults = [sum(f == name for _, f in self.rows) for name in FAULTS[1:]]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(self.rows, self.rows[1:]))
        return (*faults, illegal, self.best(0, START, 0), self.audit())


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage; nulls of role and text are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turned = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), blank("text").alias("text"),
        (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("harm"),
    ).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    turned = turned.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "harm")
    return turned.withColumn("copy", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("harm", "copy")


def _text_key() -> Column:
    return F.unhex(F.sha2(F.concat_ws("\0", "role", "text").cast("binary"), 256))


def letters(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with `said` (digest of role and text), `early` (whether the
    conversation has it at an earlier turn) and `letter` (role and fault but for duplicates).

    Only what a conversation says twice or more is listed, so no key of a join is common.
    """
    last = F.substring(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+$", ""), -1, 1)
    fault = F.when(~F.col("text").rlike(VISIBLE), 1).when(F.instr(F.lit(STOPS), last) == 0, 3).otherwise(0)
    role = F.when(F.col("role").rlike("^[sua]"), F.instr(F.lit(ROLES), F.substring("role", 1, 1)) - 1).otherwise(3)
    told = rows.withColumn("said", _text_key()).withColumn("letter", (fault * 4 + role).cast("int"))
    key = F.xxhash64(F.coalesce("conv_id", F.lit(0)), F.col("conv_id").isNull(), "said")
    told = told.withColumn("said_in", key)
    turn = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("at"))
    often = told.groupBy("said_in", "conv_id", "said").agg(F.min(turn).alias("first"), F.count("*").alias("n")).where("n > 1")
    often = often.groupBy("said_in").agg(F.collect_list(F.struct("conv_id", "said", "first")).alias("firsts"))
    met = meet(told, cut(often, "said-again"), ["said_in"], "left")
    before = F.exists("firsts", lambda f: f["conv_id"].eqNullSafe(F.col("conv_id")) & (f["said"] == F.col("said")) & (f["first"] < turn))
    return met.withColumn("early", F.coalesce(before, F.lit(False))).drop("said_in", "firsts")


def signatures(lettered: DataFrame) -> DataFrame:
    """conv_id, gaps and signature of each conversation.

    Rows of a conversation come to one task without their texts, in order, and are read as a
    stream: what is held is one letter a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now = None

        def close() -> None:
            conv_id, sign, least, most, turns = now[:5]
            done.append((conv_id, most - least + 1 - turns if turns else 0, sign.decode()))

        for batch in batches:
            for conv_id, turn, _, said, early, letter in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv_id:
                    if now is not None:
                        close()
                    now = [conv_id, bytearray(), turn, turn, 0, None]
                if turn is not None and (now[4] == 0 or turn != now[3]):
                    now[2:5] = (turn if now[4] == 0 else now[2], turn, now[4] + 1)
                if letter // 4 != 1 and (early or now[5] == (turn, said)):
                    letter = 8 + letter % 4
                now[5] = (turn, said)
                now[1] += LETTERS[letter].encode()
            if len(done) >= 1000:
                yield table(done)
                done = []
        if now is not None:
            close()
        yield table(done)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv_id", "gaps", "signature"])

    slim = lettered.select("conv_id", "turn", "role", "said", "early", "letter")
    return ordered(slim, "turn", "role", "said").mapInArrow(run, "conv_id bigint, gaps bigint, signature string")


def ordered(rows: DataFrame, *by: str) -> DataFrame:
    """rows with those of a conversation together, in order, nulls first."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", *by)


def solved(distinct: DataFrame) -> DataFrame:
    """Each signature with its faults, the cost of its repair and the audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            found = [(s, *Repair(s).result()) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.string() if i in (0, 6) else pa.int64()) for i in range(7)], [f.split()[0] for f in SOLVED.split(", ")])

    return distinct.mapInArrow(run, SOLVED)


def replayed(lines: DataFrame) -> DataFrame:
    """One row a conversation: its audit's row comes first, then its rows in order; each edit is
    replayed as it comes, into the running hash of the repaired text."""
    names = [f.split()[0] for f in REPAIRED.split(", ")]
    types = [pa.string() if f.endswith("string") else pa.int64() for f in REPAIRED.split(", ")]

    def emitted(state: int, role: str | None) -> tuple[int, str]:
        """State and role name after a row that is kept as role, or made (None)."""
        if role is not None and state == START and role.startswith("s"):
            return SYSTEM, role
        to = NEXT[state]
        return to, NAMES[EMITS[to]] if role is None else role

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now = None

        def put(role: str | None, text: str) -> None:
            now["state"], name = emitted(now["state"], role)
            now["hash"].update(f"{'' if now['first'] else chr(10)}{name}:{text}".encode())
            now["first"] = False

        def insertions() -> None:
            while now["at"] < len(now["audit"]) and now["audit"][now["at"]] == "I":
                put(None, "")
                now["at"] += 1

        def close() -> None:
            insertions()
            assert now["at"] == len(now["audit"]), "audit and rows of a conversation differ"
            done.append((*now["row"], now["hash"].hexdigest()))

        for batch in slices(batches):
            for conv_id, is_row, _, role, text, head in zip(*(c.to_pylist() for c in batch.columns)):
                if not is_row:
                    if now is not None:
                        close()
                    row = (conv_id, *head.values())
                    now = {"row": row, "audit": row[-1], "at": 0, "state": START, "hash": hashlib.sha256(), "first": True}
                    continue
                insertions()
                edit = now["audit"][now["at"]]
                now["at"] += 1
                if edit != "D":
                    put(role if edit == "K" else None, text)
            if len(done) >= 1000:
                yield table(done)
                done = []
        if now is not None:
            close()
        yield table(done)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return lines.mapInArrow(run, REPAIRED)


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest edits, audit and digest of the repaired text of every conversation.

    conversations gives the identifiers, rows (conversations itself unless given) what is left of
    them: conv_id, turn, role and text. Rows of one turn are ordered by role, then by digest. A null
    conv_id is a conversation; a null turn comes first and counts for no gap; nulls of role and text
    are one space, so such a text is blank. A conversation without rows has zeros, an empty audit
    and the digest of nothing. No row, no output. Other columns are not read. A conversation's
    signature and audit take one letter a row in memory; its texts pass through as a stream, as
    their digest is one of all of them in order.
    """
    rows = conversations if rows is None else rows
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), blank("role"), blank("text"))
    with scratch() as keep:
        lettered = letters(rows)
        signs = keep(cut(signatures(lettered), "signatures"))
        answers = keep(cut(solved(signs.select("signature").distinct()), "repairs"))
    count = [f.split()[0] for f in REPAIRED.split(", ")][1:-1]
    zeros = {n: F.lit("") if n == "audit" else F.lit(0).cast("bigint") for n in count}
    known = meet(signs, answers, ["signature"]).select("conv_id", *count, F.lit(1).alias("order"))
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().select("conv_id", *(v.alias(n) for n, v in zeros.items()), F.lit(0).alias("order"))
    head = F.max_by(F.struct(*count), F.col("order")).alias("head")
    heads = known.unionByName(ids).groupBy("conv_id").agg(head)
    none = F.lit(None)
    lines = heads.select("conv_id", F.lit(0).alias("is_row"), none.cast("bigint").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), "head", none.cast("binary").alias("said"))
    told = rows.select("conv_id", F.lit(1).alias("is_row"), "turn", "role", "text", F.lit(None).cast(lines.schema["head"].dataType).alias("head"), _text_key().alias("said"))
    return replayed(ordered(lines.unionByName(told), "is_row", "turn", "role", "said").drop("said"))
