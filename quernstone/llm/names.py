"""Names typed by people: finding them in free text and linking their spellings to the entity that is meant.

Every known name (with its aliases) is a star whose centre is its entity. Words of a text are looked up by minwise hashes of their
padded q-grams, in as many bands as the collision curve asks for at the similarity that a slip of the pen leaves. A word that
meets a name's distinctive word closely enough anchors a mention; the describing words around it (Bank, Wallet, Credit Union,
abbreviated or reordered) belong to the mention. Mentions are verified against the names by Monge-Elkan similarity and join the
star they are most like. What stays equally like to several stars is decided by the entity the record itself names, or not at all.

Short forms that no alias records (nicknames: the beginning of a name with any ending; initials, with or without letters from
within the name) are learned: a word that could be one is linked to an entity only if it stands in that entity's own records far
more often than elsewhere, counted over all records.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from quernstone.llm.overlap import banding
from quernstone.plans.session import checkpointed

#: Length of q-grams; similarity of q-gram sets after two neighbours of a short name (seven letters) changed places; how surely such words must meet.
Q, AFTER_SLIP, RECALL = 2, 0.45, 0.999
#: Least Monge-Elkan similarity of a mention and the name it is linked to.
ALIKE = 0.75
#: Weight of the mention's words against the name's, which people leave out.
MENTIONED = 0.75
#: Least number of records, and share, in which a spelling that could stand for several entities, or a short form that no alias
#: records, stands for the record's own.
LEAST_VOTES, LEAST_SHARE = 2, 0.5
#: How many times as often a short form must stand in its entity's own records as records are that entity's at all; twice is
#: enough where most records with it are the entity's.
LEAST_LIFT = 10
#: Entities whose names are broadcast at most.
MOST_ENTITIES = 200_000
#: Words whose look-up a worker remembers before it starts afresh.
REMEMBERED = 500_000

# Legal forms, which tell no firms apart, and short forms of describing words.
LEGAL = frozenset("inc llc ltd na n a co corporation corp holdings company usa and the plc".split())
SHORT = {
    "bank": "bk bnk bank banc", "national": "nat natl ntl", "savings": "sav svgs savs svg", "federal": "fed", "credit": "cr cred", "union": "un", "trust": "tr trst",
    "company": "co", "wallet": "wlt wal wallt", "payments": "pymts pmts pay pmt pymt", "financial": "fin fincl finl", "card": "crd", "services": "serv svcs srv svc servs", "remittance": "remit rmt rem",
    "group": "grp gp", "bancorp": "bncp banc bcp", "first": "1st",
}
#: First letters that a nickname shares with a name.
STEM = 4
TOGETHER = {"fcu": ["federal", "credit", "union"], "cu": ["credit", "union"]}

_WORD, _WORD_1ST = re.compile(r"[^\W\d_]+"), re.compile(r"[^\W\d_]+|1st", re.I)
_POSSESSIVE = re.compile(r"['’]s\b")
_CAPITALS = re.compile(r"\b[A-Z]{3,}\b")


def words_of(text: str) -> list[str]:
    """Words with their letters as they are; apostrophes fall away with a following s, or join what they part."""
    if "'" in text or "’" in text:
        text = _POSSESSIVE.sub("", text).replace("'", "").replace("’", "")
    return (_WORD_1ST if "1s" in text or "1S" in text else _WORD).findall(text)


def distance(a: str, b: str, most: int) -> int:
    """Edits (insertion, deletion, change, exchange of neighbours) from a to b; most + 1 if there are more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, nxt[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            nxt.append(v)
        if min(nxt) > most:
            return most + 1
        before, row = row, nxt
    return row[-1]


_LONG = {s: word for word, shorts in SHORT.items() for s in [word, *shorts.split()]}
_DESCRIBING = [*SHORT, "of"]
_describing_memo: dict[str, str | None] = {}


def describing(word: str) -> str | None:
    """The describing word that is meant, or None."""
    if word not in _describing_memo:
        if len(_describing_memo) > REMEMBERED:
            _describing_memo.clear()
        got = _LONG.get(word) or ("of" if word == "of" else None)
        if got is None and len(word) >= 4:
            got = next((d for d in _DESCRIBING if len(d) > 3 and distance(word, d, 1) <= 1), None)
        _describing_memo[word] = got
    return _describing_memo[word]


def inner(a: str, b: str, most: int | None = None) -> float:
    """Similarity of two words; 0 beyond ``most`` edits."""
    if a == b:
        return 1.0
    longest = max(len(a), len(b))
    edits = distance(a, b, longest if most is None else most)
    return 0.0 if most is not None and edits > most else 1 - edits / longest


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean of the best matches of a's words in b, and with less weight of b's words in a."""
    if not a or not b:
        return 0.0
    one = [[inner(x, y) for y in b] for x in a]
    return MENTIONED * sum(max(r) for r in one) / len(a) + (1 - MENTIONED) * sum(max(r[j] for r in one) for j in range(len(b))) / len(b)


class Stars:
    """Index of all names. ``entities``: (id, name, aliases)."""

    def __init__(self, entities: Iterable[tuple[str, str | None, list[str] | None]]) -> None:
        self.bands, self.rows = banding(AFTER_SLIP, RECALL, 40)
        rng = np.random.default_rng(11)
        self.odd = rng.integers(0, 2**31, self.bands * self.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 2**63, self.bands * self.rows, dtype=np.uint64)
        self.core_of: dict[str, list[str]] = {}  # id -> words of its name that describe nothing
        self.kind_of: dict[str, list[str]] = {}  # id -> describing words
        self.by_core: dict[str, set[str]] = defaultdict(set)
        self.single: dict[str, set[str]] = defaultdict(set)  # one-word aliases that aren't spellings of the core
        self.joined: dict[str, set[str]] = defaultdict(set)
        entities = list(entities)
        for i, name, _ in entities:
            words = [w.lower() for w in words_of(name or "")]
            kinds = [LONG for w in words if (LONG := _LONG.get(w) or ("of" if w == "of" else None))]
            core = [w for w in words if w not in LEGAL and w not in _LONG and w != "of"]
            if not core:
                continue
            if words.count("trust") and "company" not in kinds and "company" in words:
                kinds.append("company")
            kinds = [k for k in kinds if k != "company" or "trust" in words]
            self.core_of[i], self.kind_of[i] = core, kinds
            self.by_core["".join(core)].add(i)
            plain = [w for w in words if w not in LEGAL or w == "company" and "trust" in words]
            self.joined["".join(plain)].add(i)
        for i, _, aliases in entities:
            if i not in self.core_of:
                continue
            core = "".join(self.core_of[i])
            for alias in aliases or []:
                words = [w.lower() for w in words_of(alias or "")]
                if len(words) == 1 and words[0] not in _LONG and distance(words[0], core, 2) > 2 and not words[0].startswith(core[:5]):
                    self.single[words[0]].add(i)
        self.stems: dict[str, set[str]] = defaultdict(set)  # first letters -> entities
        self.ends: dict[tuple[str, str], set[str]] = defaultdict(set)  # (first letter, initials of the describing words) -> entities
        for i, core in self.core_of.items():
            c = "".join(core)
            self.stems[c[:STEM]].add(i)
            self.ends[c[0], "".join(k[0] for k in self.kind_of[i] if k != "of")].add(i)
        self.buckets: dict[int, list[str]] = defaultdict(list)
        spelt = {**self.by_core, **{j: ids for j, ids in self.joined.items() if j not in self.by_core}}
        # recorded short forms are met as they are: a slip in one would make it another
        self.targets = {**spelt, **{w: ids for w, ids in self.single.items() if w not in spelt}}
        for t in spelt:
            for k in self.keys(t):
                self.buckets[k].append(t)
        self.letters = {t: frozenset(t) for t in self.targets}
        self.memo: dict[str, tuple[int, list[str]]] = {}
        self.starts = {c[:3] for c in self.by_core}
        self.short: dict[tuple[str, bool], list[str]] = {}
        self.verdicts: dict[tuple[str, ...], list[str]] = {}
        self.dull: set[str] = set()

    def keys(self, word: str) -> list[int]:
        """Buckets of a word's padded q-grams."""
        s = "^" * (Q - 1) + word + "$" * (Q - 1)
        grams = np.array([zlib.crc32(s[i : i + Q].encode()) for i in range(len(s) - Q + 1)], np.uint64)
        h = ((grams[None, :] ^ self.shift[:, None]) * self.odd[:, None]).min(axis=1)
        h = h.reshape(self.bands, self.rows)
        out = np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(self.rows):
            out = (out ^ h[:, r]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        return out.tolist()

    def nearest(self, word: str) -> tuple[float, list[str]]:
        """(similarity, targets) of the names' distinctive words, joined names or recorded short forms most like it; none below ``ALIKE``."""
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > REMEMBERED:
                self.memo.clear()
            if word in self.targets:
                got = (1.0, [word])
            elif word in _LONG:
                got = (0.0, [])
            else:
                most = int(len(word) * (1 - ALIKE) / ALIKE)  # edits to a longer word that leave ALIKE; inner() decides
                # an edit changes one letter: words that lack more of each other's letters are never compared
                own, letters = frozenset(word), self.letters
                met = {t for k in self.keys(word) for t in self.buckets.get(k, ())}
                near = [(inner(word, t, most), t) for t in met if len(own - letters[t]) <= most and len(letters[t] - own) <= most]
                best = max((s for s, _ in near), default=0.0)
                got = (best, sorted(t for s, t in near if s == best)) if best >= ALIKE else (0.0, [])
            self.memo[word] = got
        return got

    def could_be(self, word: str, capitals: bool) -> list[str]:
        """Entities for which the word could be a short form that no alias records."""
        got = self.short.get((word, capitals))
        if got is None:
            if len(self.short) > REMEMBERED:
                self.short.clear()
            ids = set(self.stems.get(word[:STEM], ())) if len(word) >= STEM and word not in _LONG else set()
            for k in range(1, len(word)) if capitals and len(word) >= 3 else ():
                ids |= {i for i in self.ends.get((word[0], word[k:]), ()) if _within(word[1:k], "".join(self.core_of[i])[1:])}
            got = self.short[word, capitals] = sorted(ids)
        return got

    def cut(self, word: str) -> list[str]:
        """The distinctive word that a longer word begins with, when a describing word follows it without a blank."""
        for size in range(len(word) - 3, 2, -1):
            if word[:size] in self.by_core:
                rest = word[size:]
                if any(d.startswith(r) or r.startswith(d) for d in SHORT for r in (rest, rest[1:]) if len(r) >= 3):
                    return [word[:size]]
        return []

    def _kinds_at(self, word: str) -> list[str]:
        return TOGETHER.get(word) or ([d] if (d := describing(word)) else [])

    def mentions(self, text: str | None) -> list[tuple[str, list[str], bool]]:
        """(spelling, entities it is most like, whether it is only a guess) of every mention; several entities where it is equally like them."""
        found: list[tuple[str, list[str], bool]] = []
        if not text:
            return found
        raw = words_of(text)
        low = "\0".join(raw).lower().split("\0")
        if len(low) != len(raw):
            low = [w.lower() for w in raw]
        mixed = raw != low and not text.isupper()
        dull, n, after = self.dull, len(low), 0
        # most words are known to begin no mention
        shouted = {w.lower() for w in _CAPITALS.findall(text)} if mixed else ()
        for i in [i for i, w in enumerate(low) if w not in dull or w in shouted]:
            if i < after:
                continue
            w, width, targets = low[i], 1, []
            capitals = mixed and raw[i].isupper()
            if w[:3] in self.starts and i + 1 < n and w not in self.by_core:
                for k in (2, 3):
                    joint = "".join(low[i : i + k])
                    if i + k <= n and joint in self.by_core:
                        width, targets = k, [joint]
                        break
                    if k == 2 and len(w) >= 3 and describing(low[i + 1]) is None and not self.nearest(w)[1] and low[i + 1] not in _SMALL and self.nearest(joint)[0] >= 1 - 1 / len(joint):
                        width, targets = 2, self.nearest(joint)[1]
                        break
            anchor = "".join(low[i : i + width])
            if not targets:
                targets = self.nearest(w)[1]
            if not targets and (targets := self.cut(w)):
                anchor = targets[0]
            if not targets:
                if ids := self.could_be(w, capitals):
                    found.append((raw[i], ids, True))
                elif w[:3] not in self.starts:
                    if len(dull) > REMEMBERED:
                        dull.clear()
                    dull.add(w)
                continue
            around, j = [], i + width
            while j < n and (d := self._kinds_at(low[j])):
                around += d
                j += 1
            k = i - 1
            while k >= 0 and (d := self._kinds_at(low[k])):
                around = d + around
                k -= 1
            if around and around[0] == "of":
                around = around[1:]
            if ids := self._verified(targets, anchor, around):
                found.append((" ".join(raw[k + 1 : j]) if targets[0] not in self.single else raw[i], ids, False))
            after = j
        return found

    def _verified(self, targets: list[str], spelt: str, around: list[str]) -> list[str]:
        """The stars that the mention is most like. People repeat themselves: answers are remembered."""
        asked = (spelt, *targets, "", *around)
        if (got := self.verdicts.get(asked)) is None:
            if len(self.verdicts) > REMEMBERED:
                self.verdicts.clear()
            got = self.verdicts[asked] = self._most_like(targets, spelt, around)
        return got

    def _most_like(self, targets: list[str], spelt: str, around: list[str]) -> list[str]:
        scores: dict[str, float] = {}
        for t in targets:
            for i in self.targets[t]:
                core = "".join(self.core_of[i])
                if t == core:
                    # words that are left out hardly count against a mention, other words do
                    full = monge_elkan([spelt, *around], [core, *self.kind_of[i]])
                    scores[i] = full if around else inner(spelt, core) - 0.05
                else:
                    scores[i] = inner(spelt, t)
        best = max(scores.values(), default=0.0)
        if best < ALIKE:
            return []
        return sorted(i for i, s in scores.items() if s >= best - 1e-9)


def _within(letters: str, word: str) -> bool:
    """Whether the letters occur in the word in this order."""
    rest = iter(word)
    return all(c in rest for c in letters)


@functools.lru_cache(maxsize=2)
def _stars(shared: Broadcast) -> Stars:
    """The index of a broadcast, built once in a worker."""
    return Stars(shared.value)


# Small words that never are the second half of a name cut in two.
_SMALL = frozenset("i a an and as at but by for from in is it my no of on or so the this that then they to was we were with when while which who not had has have me after before since until".split())


def link(df: DataFrame, key: str, text: str, own: str, entities: DataFrame, entity: str, name: str, aliases: str) -> DataFrame:
    """(key, entity, spelling): one row for each entity that the text of a key's records names, with one of its spellings.

    ``own``: column with the entity of the record itself, which may be null. A spelling that several entities share equally goes to
    the one for which it stands in most records of those entities themselves, counted over all records; failing that to the
    record's own, if it is among them, or to nobody. An unrecorded short form goes to the entity in whose own records it stands far
    more often than elsewhere, or to nobody. ``entities`` is a table of fixed size (more than ``MOST_ENTITIES`` rows
    raise); null names and aliases know no spelling, repeated ones count once. Null and empty texts name nobody. Null keys are
    a key. Empty tables give no rows.
    """
    rows = entities.select(F.col(entity), F.col(name), F.col(aliases)).where(F.col(entity).isNotNull()).limit(MOST_ENTITIES + 1).collect()
    if len(rows) > MOST_ENTITIES:
        raise ValueError(f"more than {MOST_ENTITIES} entities")
    known = sorted({(r[0], r[1], tuple(r[2] or ())) for r in rows}, key=lambda r: (r[0], r[1] or "", [x or "" for x in r[2]]))
    shared = df.sparkSession.sparkContext.broadcast([(i, n, list(a)) for i, n, a in known])
    fields = [T.StructField("id", df.schema[key].dataType), T.StructField("own", T.StringType()), T.StructField("spelling", T.StringType()), T.StructField("ids", T.ArrayType(T.StringType())), T.StructField("guess", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars = _stars(shared)
        for batch in batches:
            row, ids, spelt, guess = [], [], [], []
            for r, t in enumerate(batch.column("text").to_pylist()):
                for s, i, g in stars.mentions(t):
                    row.append(r)
                    ids.append(i)
                    spelt.append(s)
                    guess.append(g)
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("own").take(at), pa.array(spelt, pa.string()), pa.array(ids, pa.list_(pa.string())), pa.array(guess, pa.bool_())], names=["id", "own", "spelling", "ids", "guess"])

    mentioned = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(own).cast("string").alias("own")).mapInArrow(run, T.StructType(fields))
    mentioned = checkpointed(mentioned.withColumn("word", F.lower("spelling")))
    unsure = mentioned.where("size(ids) > 1 or guess")
    fits = lambda c: F.when(F.array_contains("ids", F.col(c)), F.col(c))
    # per spelling and entity: partial sums, then a row for each entity that a spelling could stand for (null: records of others)
    votes = unsure.groupBy("word", "guess", fits("own").alias("own")).agg(F.count("*").alias("n"))
    learned = votes.groupBy("word", "guess").agg(F.max(F.when(F.col("own").isNotNull(), F.struct("n", "own"))).alias("best"), F.sum(F.when(F.col("own").isNotNull(), F.col("n"))).alias("likely"), F.sum("n").alias("total"))
    learned = learned.where((F.col("best.n") >= LEAST_VOTES) & (F.col("best.n") > LEAST_SHARE * F.col("likely")))
    # a short form is told from an ordinary word by standing in its entity's records far more often than in others
    owners = df.where(F.col(own).isNotNull()).groupBy(F.col(own).cast("string").alias("voted")).agg(F.count("*").alias("owned"))
    everything = df.where(F.col(own).isNotNull()).count()
    learned = learned.select("word", "guess", F.col("best.own").alias("voted"), F.col("best.n").alias("n"), "total").join(owners, "voted")
    lift = F.col("n") * everything / (F.col("total") * F.col("owned"))
    learned = learned.where(~F.col("guess") | (lift >= LEAST_LIFT) | (F.col("n") > LEAST_SHARE * F.col("total")) & (lift >= 2)).select("word", "guess", "voted")
    # a row per spelling; a popular one may have many mentions, which AQE then splits
    decided = unsure.join(learned, ["word", "guess"], "left")
    decided = decided.select("id", F.coalesce(fits("voted"), F.when(~F.col("guess"), fits("own"))).alias("entity"), "spelling").where("entity is not null")
    clear = mentioned.where("size(ids) = 1 and not guess").select("id", F.element_at("ids", 1).alias("entity"), "spelling")
    return clear.unionAll(decided).groupBy(F.col("id").alias(key), F.col("entity").alias(entity)).agg(F.min("spelling").alias("spelling"))
