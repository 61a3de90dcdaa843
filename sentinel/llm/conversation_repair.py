"""Cheapest repair of conversation structure on a suffix-shared automaton of role and fault signatures.

A conversation becomes a word of one letter per row: the class of its role's initial (s, u, a, other) and its first
fault (none, blank, duplicate, truncated). Distinct words are sorted by their reversed letters, so that words with a common
end stand side by side. Each end is one automaton node, made once: it holds, for each of the four grammar states, the cost to go and the first
edit of the best audit from there. The best audit of a node is its first edit and the audit of the node that follows, so none is copied.
Distinct words are repaired once for all conversations that share them.

Grammar of role initials: (s?(ua)+)?. Edits: Keep costs 0, Rerole (to user or assistant) 2, Delete 3 (required for blank and
duplicate rows), Insert (an empty text of user or assistant) 2; a truncated row that is not deleted adds 1. Among the cheapest the audit that is
least in ASCII wins. Every edit has its own initial, so equal costs are settled by the first initial alone.

Rows are ordered by turn (nulls first), then role, then a hash of role and text; equal rows are counted, so they are adjacent, and all but
the first are duplicates. The order is a range partitioning: a conversation of any length spreads over many tasks, and only its word (one letter
a row) comes together, as its audit must. What is held in a task besides is the automaton path of one word, some 40 bytes a letter.

Defined cases: null roles and texts are one space; rows with a null conv_id form one conversation. A role that does not begin
with s, u or a cannot be kept. Conversations without rows have zeros, an empty audit and no repaired rows. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentinel.functions.storage import cut_lineage
from sentinel.llm.keyed import join_by_key

# Role classes, faults, what a role class does in each grammar state, the role that each state asks for, and costs.
CLASSES, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
RIGHT_PAIRS = ("su", "ua", "au")
DELETE, INSERT, REROLE, LEFT_TRUNCATED = 3, 2, 2, 1
FIRST_LETTER = ord("A")
# Edits with their role: K keep, D delete, U and A rerole, u and a insert. In this order their initials D, I, K, R ascend.
EDITS, RANK = "DuaKUA", {c: r for c, r in zip("DuaKUA", (0, 1, 1, 2, 3, 3))}
AUDIT = str.maketrans("uaUA", "IIRR")
NAMES = {"u": "user", "a": "assistant"}
SOLID = r"[^\x20\x09-\x0D]"


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage that the checksum of conv_id and turn decides."""
    blank = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
                                (F.crc32(named) % 20).alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def _conv(name: str = "conv_id") -> Column:
    """A key without nulls."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with a key of the conversation and a hash of role and text."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(_conv().alias("_conv"), F.col("turn").alias("_turn"), role.alias("_role"), text.alias("_text"),
                       F.xxhash64(role, text).alias("_h1"), F.xxhash64(F.lit(31), text, role).alias("_h2"))


def _letter(role_class: Column, fault: Column) -> Column:
    return F.chr(FIRST_LETTER + 4 * role_class + fault)


def ordered(rows: DataFrame) -> DataFrame:
    """One stored row per group of equal rows: _conv, _part (of the range order), _at (its place in that part of the conversation), _n
    (equal rows), _letter (of the first) and _again (of the others)."""
    initial = F.substring("_role", 1, 1)
    role_class = F.lit(len(CLASSES))
    for i, c in enumerate(CLASSES):
        role_class = F.when(initial == c, i).otherwise(role_class)
    blank = ~F.col("_text").rlike(SOLID)
    open_end = ~F.col("_text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(open_end, TRUNCATED).otherwise(NONE)
    light = _keyed(rows).select("_conv", "_turn", "_role", "_h1", "_h2", role_class.alias("_class"), fault.alias("_fault"))
    groups = cut_lineage(light.groupBy(*light.columns).agg(F.count(F.lit(1)).alias("_n")))
    first = F.min(F.struct(F.col("_turn").isNotNull().alias("known"), F.col("_turn").alias("turn"))).alias("_first")
    seen = groups.groupBy("_conv", "_h1", "_h2").agg(first, F.count(F.lit(1)).alias("_held")).where("_held > 1")
    marked = join_by_key(groups, cut_lineage(seen), ["_conv", "_h1", "_h2"], "_held", how="left")
    later = F.col("_first").isNotNull() & ~F.col("_turn").eqNullSafe(F.col("_first.turn"))
    fault = F.when((F.col("_fault") != BLANK) & later, DUPLICATE).otherwise(F.col("_fault"))
    again = F.when(fault == BLANK, BLANK).otherwise(DUPLICATE)
    order = [F.col("_conv"), F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_h1"), F.col("_h2")]
    letters = marked.select("_conv", "_turn", "_role", "_h1", "_h2", "_n", _letter(F.col("_class"), fault).alias("_letter"),
                            _letter(F.col("_class"), again).alias("_again"))
    ranged = letters.repartitionByRange(*order).sortWithinPartitions(*order).drop("_turn", "_role")
    numbered = cut_lineage(ranged.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    before = F.sum("_n").over(W.partitionBy("_conv", "_part").orderBy("_id").rowsBetween(W.unboundedPreceding, -1))
    return cut_lineage(numbered.withColumn("_at", F.coalesce(before, F.lit(0))).drop("_id"))


def signatures(places: DataFrame) -> DataFrame:
    """_conv and its word. Letters come together part by part, then the parts of a conversation."""
    letters = F.concat("_letter", F.repeat("_again", (F.col("_n") - 1).cast("int")))
    joined = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, "_word"))), lambda x: x["_word"]), "")
    parts = places.select("_conv", "_part", "_at", letters.alias("_word")).groupBy("_conv", "_part").agg(joined("_at").alias("_word"))
    return parts.groupBy("_conv").agg(joined("_part").alias("_word"))


@dataclass
class Automaton:
    """The nodes on the path of the current word, from its end; a node is made once for all words that end alike."""

    costs: array
    edits: bytearray
    word: str = ""
    made: int = 0

    @staticmethod
    def empty() -> Automaton:
        """The node of the empty word: states that accept end here, the others insert what is missing."""
        return Automaton(array("q", [0, 2 * INSERT, INSERT, 0]), bytearray(b".ua."))

    def push(self, letter: str) -> None:
        """The node of one more row before the current one."""
        role_class, fault = divmod(ord(letter) - FIRST_LETTER, 4)
        follow = self.costs[-4:]
        best = []
        for state in range(4):
            options = [(DELETE + follow[state], "D")]
            if fault in (NONE, TRUNCATED):
                extra = LEFT_TRUNCATED if fault == TRUNCATED else 0
                if (state, role_class) in STEP:
                    options.append((extra + follow[STEP[state, role_class]], "K"))
                options.append((extra + REROLE + follow[AFTER[state]], WANTED[state].upper()))
            best.append(min(options, key=lambda o: (o[0], RANK[o[1]])))
        for states in ((USER, ASSISTANT), (START, SYSTEM)):  # inserts never return to their state, and the first two decide the others
            before = list(best)
            for state in states:
                best[state] = min(best[state], (INSERT + before[AFTER[state]][0], WANTED[state]), key=lambda o: (o[0], RANK[o[1]]))
        self.costs.extend(c for c, _ in best)
        self.edits.extend(ord(e) for _, e in best)
        self.made += 1

    def move(self, word: str) -> None:
        """Go to the node of ``word``, over the node of the longest common end with the last word."""
        shared = 0
        for x, y in zip(reversed(word), reversed(self.word)):
            if x != y:
                break
            shared += 1
        del self.costs[4 * (shared + 1):], self.edits[4 * (shared + 1):]
        for letter in reversed(word[:len(word) - shared]):
            self.push(letter)
        self.word = word

    def best(self) -> tuple[int, str]:
        """Cost and edits of the current word from the start of the grammar."""
        out, state, node = [], START, len(self.word)
        while True:
            edit = chr(self.edits[4 * node + state])
            if edit == ".":
                return self.costs[4 * len(self.word)], "".join(out)
            out.append(edit)
            if edit == "K":
                state = STEP[state, (ord(self.word[len(self.word) - node]) - FIRST_LETTER) // 4]
            elif edit != "D":
                state = AFTER[state]
            if edit not in "ua":
                node -= 1


def _illegal(word: str) -> int:
    """Adjacent rows whose role classes are no right pair."""
    classes = (np.frombuffer(word.encode(), np.uint8).astype(np.int64) - FIRST_LETTER) // 4
    right = {4 * CLASSES.index(a) + CLASSES.index(b) for a, b in RIGHT_PAIRS}
    return int((~np.isin(4 * classes[:-1] + classes[1:], list(right))).sum())


def solve(words: DataFrame) -> DataFrame:
    """For distinct words: blank, duplicate, truncated, illegal, cost and edits."""
    counted = [BLANK, DUPLICATE, TRUNCATED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.empty()
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024).column("_word").to_pylist()
                rows = []
                for word in part:
                    automaton.move(word)
                    faults = [sum(word.count(chr(FIRST_LETTER + 4 * c + f)) for c in range(4)) for f in counted]
                    rows.append((word, *faults, _illegal(word), *automaton.best()))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["_word", "blank", "duplicate", "truncated", "illegal", "cost", "edits"])

    back = F.reverse("_word")
    ranged = words.select("_word").repartitionByRange(back).sortWithinPartitions(back)
    return ranged.mapInArrow(run, "_word string, blank long, duplicate long, truncated long, illegal long, cost long, edits string")


@dataclass(frozen=True)
class Repair:
    """``report`` has a row per conversation with rows; ``repaired`` has their new rows (_conv, _place, _nth in that place, role, text)."""

    report: DataFrame
    repaired: DataFrame


def repair(rows: DataFrame) -> Repair:
    """Repairs the conversations of ``rows`` (conv_id, turn, role, text)."""
    places = ordered(rows)
    words = cut_lineage(signatures(places))
    solved = cut_lineage(solve(words.groupBy("_word").agg(F.count(F.lit(1)).alias("_held"))))
    held = cut_lineage(words.groupBy("_word").agg(F.count(F.lit(1)).alias("_held")).join(solved, "_word"))
    found = join_by_key(words, held, ["_word"], "_held")
    known = F.col("turn").isNotNull()
    turns = rows.select(_conv().alias("_conv"), "turn").groupBy("_conv", "turn").agg(F.lit(1).alias("_one"))
    turns = turns.groupBy("_conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_if(known)).alias("gaps"))
    audit = F.translate("edits", "uaUA", "IIRR")
    report = found.join(turns, "_conv").select("_conv", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
                                               "cost", audit.alias("audit"), "edits")
    return Repair(report, _apply(rows, places, found))


def _offsets(places: DataFrame) -> DataFrame:
    """Rows before each part of a conversation. Only conversations of several parts are listed: at most twice as many rows as parts."""
    parts = places.groupBy("_conv", "_part").agg(F.sum("_n").alias("_rows"))
    several = parts.join(parts.groupBy("_conv").agg(F.count(F.lit(1)).alias("_parts")).where("_parts > 1"), "_conv", "left_semi")
    before = F.sum("_rows").over(W.partitionBy("_conv").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    return several.select("_conv", "_part", F.coalesce(before, F.lit(0)).alias("_before"))


def _apply(rows: DataFrame, places: DataFrame, found: DataFrame) -> DataFrame:
    """The rows that the edits leave or make. Edits meet rows by place, and rows meet their texts by hash."""
    tokens = found.select("_conv", F.posexplode(F.regexp_extract_all("edits", F.lit("[ua]*[KDUA]|[ua]+"), F.lit(0))).alias("_place", "_edit"))
    tokens = tokens.where("_edit <> 'D'").withColumn("_place", F.col("_place").cast("long"))
    placed = places.join(F.broadcast(_offsets(places)), ["_conv", "_part"], "left")
    placed = placed.select("_conv", (F.col("_at") + F.coalesce("_before", F.lit(0))).alias("_place"), "_h1", "_h2")
    edited = tokens.join(placed, ["_conv", "_place"], "left")
    keyed = _keyed(rows)
    texts = keyed.groupBy("_conv", "_h1", "_h2").agg(F.first(F.struct("_role", "_text")).alias("_row"))
    stays = F.col("_edit").rlike("[KUA]")
    joined = edited.where(stays).join(texts, ["_conv", "_h1", "_h2"]).select("_conv", "_place", "_edit", "_row")
    none = edited.where(~stays).select("_conv", "_place", "_edit", F.lit(None).cast("struct<_role:string,_text:string>").alias("_row"))
    made = lambda e: F.struct(
        F.when(F.lower(e) == "u", NAMES["u"]).when(F.lower(e) == "a", NAMES["a"]).otherwise(F.col("_row._role")).alias("role"),
        F.when((e == "u") | (e == "a"), "").otherwise(F.col("_row._text")).alias("text"))
    pieces = F.transform(F.filter(F.split("_edit", ""), lambda e: (e != "D") & (e != "")), made)
    return joined.union(none).select("_conv", "_place", F.posexplode(pieces).alias("_nth", "_new")).select("_conv", "_place", "_nth", "_new.role", "_new.text")


def digests(repaired: DataFrame) -> DataFrame:
    """_conv and the hash of its role:text lines, taken line by line in order; one line and one hash are in memory."""
    lines = repaired.select("_conv", "_place", "_nth", F.concat("role", F.lit(":"), "text").alias("_line"))
    dealt = lines.repartition("_conv").sortWithinPartitions("_conv", "_place", "_nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running = None, hashlib.sha256()
        row = lambda: pa.RecordBatch.from_arrays([pa.array([current]), pa.array([running.hexdigest()])], ["_conv", "repaired_sha256"])
        for batch in batches:
            done: list[tuple[str, str]] = []
            for conv, line in zip(batch.column("_conv").to_pylist(), batch.column("_line").to_pylist()):
                if conv != current:
                    if current is not None:
                        done.append((current, running.hexdigest()))
                    current, running = conv, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(line.encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["_conv", "repaired_sha256"])
        if current is not None:
            yield row()

    return dealt.mapInArrow(run, "_conv string, repaired_sha256 string")


def audit_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: the report of its ``rows`` and the digest of what the repair leaves."""
    done = repair(rows)
    ids = conversations.groupBy(_conv().alias("_conv")).agg(F.first("conv_id").alias("conv_id"))
    joined = ids.join(done.report, "_conv", "left").join(digests(done.repaired), "_conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
