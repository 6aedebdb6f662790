"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around what they find.

The lexicon is learned from labelled texts: whole words, and stems (a first part of words, whatever follows), that
stand in toxic texts far more often than chance. It is kept as a trie. The product of the trie with the Levenshtein
automata of its terms is made deterministic while texts are read: a state holds the trie nodes that the letters so
far may have reached and the edits each has cost, and every transition is computed once. A word costs one table
look-up for each letter until its state is empty, which for most words is after two or three.

A hit is judged by how often its spelling, or else its term at that distance, stood in toxic training texts, and by its
context window: quotation marks around it and the words beside it, each weighed by the hits of toxic and of clean
training texts that they stood beside. A text's score comes from its two strongest hits, by a logistic regression.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.llm import common
from obsframe.llm.neardup import mix

TRAIN_ROWS = 20_000     # expected number of labelled texts that the model is fitted on
STEMS = range(4, 9)     # lengths of stems
LONGEST = 24            # letters of a term; longer words are no terms
LEAST_TEXTS = 3         # different toxic texts that a term must stand in
LEAST_Z = 2.6           # of the term's log odds ratio
LEAST_LIFT = 2.0        # how much likelier a text with the term is toxic than any text
EDIT_RATE = 0.3         # edits of a term that stand in toxic texts less often are not looked for
STRONG_Z = 5.0          # weaker terms are taken only if a toxic text has no other yet
DEFINITE = 0.95         # share of a stem's texts from which a longer form replaces it
MISSPELLED = 0.6        # for each edit: expected share of a term's rate in toxic texts, until spellings have been seen
EDITS = ((8, 2), (5, 1))  # terms of so many letters may be misspelled by so many edits
WINDOW = 6              # words on each side
BUCKETS = 1 << 12       # of context words
WEIGHT = 2.0            # of the coarser rate when a finer one is estimated
KNOWN = 400_000         # remembered words; the memory starts afresh beyond
PREDICT = 0.3
# Quotation marks that open and close.
OPENING, CLOSING = "\"'“„«‹‘‚「『", "\"'”“»›’‘」』"


def edits_of(term: str) -> int:
    size = len(term.rstrip("*"))
    return next((k for length, k in EDITS if size >= length), 0)


def pieces(token: str) -> list[str]:
    """The forms of a token that are looked up: without marks at its ends, and the parts between inner marks."""
    if token.isalnum():
        return [token]
    start, end = 0, len(token)
    while start < end and not token[start].isalnum():
        start += 1
    while end > start and not token[end - 1].isalnum():
        end -= 1
    core = token[start:end]
    if not core or core.isalnum():
        return [core] if core else []
    parts = "".join(c if c.isalnum() else " " for c in core).split()
    return [core, *(p for p in parts if len(p) > 1)]


class Automaton:
    """The lexicon trie times the Levenshtein automata of its terms, made deterministic on demand."""

    LIMIT = 100_000  # remembered states; they start afresh beyond

    def __init__(self, terms: list[str], edits: list[int] | None = None):
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.room = [0]  # most edits of a term at or below a node
        self.terms, self.edits = terms, edits or [edits_of(t) for t in terms]
        for i, term in enumerate(terms):
            node = 0
            self.room[0] = max(self.room[0], self.edits[i])
            for c in term.rstrip("*"):
                if c not in self.kids[node]:
                    self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                    self.ends.append([])
                    self.room.append(0)
                node = self.kids[node][c]
                self.room[node] = max(self.room[node], self.edits[i])
            self.ends[node].append(i)
        self.forget()

    def forget(self) -> None:
        """States get numbers; `moves` holds the computed transitions of each, -1 for the empty state."""
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.words: list[list[tuple[int, int]]] = []  # terms that are read to their end, as (term, edits)
        self.stems: list[list[tuple[int, int]]] = []
        self.numbered(self.closed({0: 0}))

    def numbered(self, state: tuple) -> int:
        if not state:
            return -1
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            read = [(i, cost) for node, cost in state for i in self.ends[node] if cost <= self.edits[i]]
            self.words.append([r for r in read if not self.terms[r[0]].endswith("*")])
            self.stems.append([r for r in read if self.terms[r[0]].endswith("*")])
        return self.number[state]

    def closed(self, at: dict[int, int]) -> tuple:
        """The state of nodes and edits, with every node that skipping letters of a term reaches."""
        todo = list(at)
        while todo:
            node = todo.pop()
            cost = at[node] + 1
            for child in self.kids[node].values():
                if cost <= self.room[child] and cost < at.get(child, 1 << 30):
                    at[child] = cost
                    todo.append(child)
        return tuple(sorted(at.items()))

    def step(self, state: int, c: str) -> int:
        at: dict[int, int] = {}
        for node, cost in self.states[state]:
            for letter, child in self.kids[node].items():
                now = cost + (letter != c)
                if now <= self.room[child] and now < at.get(child, 1 << 30):
                    at[child] = now
            if cost + 1 <= self.room[node] and cost + 1 < at.get(node, 1 << 30):
                at[node] = cost + 1
        self.moves[state][c] = found = self.numbered(self.closed(at))
        return found

    def matches(self, word: str) -> dict[int, int]:
        """{term: edits} of the terms that `word` may be; a stem is met by any word that goes on after it."""
        if len(self.states) > self.LIMIT:
            self.forget()
        state, out, moves, stems = 0, {}, self.moves, self.stems
        for c in word:
            now = moves[state].get(c)
            state = self.step(state, c) if now is None else now
            if state < 0:
                return out
            for i, cost in stems[state]:
                out[i] = min(cost, out.get(i, cost))
        for i, cost in self.words[state] if word else ():
            out[i] = cost
        return out


@dataclass
class Model:
    """Everything that scoring needs; its size is bounded by the training sample."""
    terms: list[str] = field(default_factory=list)
    strength: list[float] = field(default_factory=list)
    edits: list[int] = field(default_factory=list)
    base: float = 0.0
    by_term: dict[tuple[int, int], float] = field(default_factory=dict)
    by_form: dict[str, float] = field(default_factory=dict)
    quoted: float = 0.0
    context: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    silent: float = 0.05    # score of a text without hits
    line: tuple[float, float] = (-3.0, 1.0)


@dataclass
class Hit:
    form: str
    term: int
    edits: int
    quoted: bool
    beside: list[int]


def bucket(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) % BUCKETS


class Finder:
    """Hits of texts. Words met before are looked up in a table."""

    def __init__(self, model: Model):
        self.model, self.automaton = model, Automaton(model.terms, model.edits)
        self.clean: set[str] = set()
        self.known: dict[str, tuple[str, int, int]] = {}
        self.hashes: dict[str, int] = {}

    def better(self, word: str) -> tuple[str, int, int] | None:
        """(form, term, edits) of the strongest reading of a word."""
        found = [(-edits, self.model.strength[i], -i) for i, edits in self.automaton.matches(word).items()]
        if not found:
            return None
        edits, _, i = max(found)
        return word, -i, -edits

    def look(self, token: str) -> None:
        found = [m for p in pieces(token) if (m := self.better(p))]
        if found:
            self.known[token] = min(found, key=lambda m: (m[2], m[0]))
        else:
            self.clean.add(token)

    def hits(self, text: str | None) -> list[Hit]:
        tokens = (text or "").lower().split()
        different = set(tokens)
        new = different - self.clean
        new -= self.known.keys()
        if new:
            if len(self.clean) > KNOWN:
                self.clean.clear()
            if len(self.known) > KNOWN:
                self.known.clear()
                new = different - self.clean
            for token in new:
                self.look(token)
        if different.isdisjoint(self.known):
            return []
        return [Hit(*self.known[t], *self.around(tokens, i)) for i, t in enumerate(tokens) if t in self.known]

    def around(self, tokens: list[str], at: int) -> tuple[bool, list[int]]:
        """Whether quotation marks enclose the word, and the buckets of the words beside it."""
        before, after = tokens[max(0, at - WINDOW):at], tokens[at + 1:at + 1 + WINDOW]
        opened = tokens[at][0] in OPENING
        for t in reversed(before if not opened else []):
            if t[-1] in CLOSING and len(t) > 1:
                break
            if t[0] in OPENING:
                opened = True
                break
        ends = lambda t: t.rstrip(".,;:!?")[-1:] in CLOSING and t.rstrip(".,;:!?") != ""
        return opened and any(map(ends, [tokens[at], *after])), [bucket(t.strip(".,;:!?")) for t in (*before, *after)]


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def rate_of(model: Model, hit: Hit) -> float:
    if hit.form in model.by_form:
        return model.by_form[hit.form]
    return model.by_term[hit.term, hit.edits]


def strength_of(model: Model, hit: Hit) -> float:
    """Log odds that the hit is abuse, against those of any text."""
    beside = float(np.clip(model.context[hit.beside].sum(), -2, 2)) if hit.beside else 0.0
    return logit(rate_of(model, hit)) - logit(model.base) + beside + (model.quoted if hit.quoted else 0.0)


def evidence(model: Model, hits: list[Hit]) -> float:
    """The strongest hit and half of the second, if that speaks for abuse."""
    best = sorted((strength_of(model, h) for h in hits), reverse=True)
    return best[0] + max(0.0, *best[1:2], 0.0) / 2


def score_of(model: Model, hits: list[Hit]) -> float:
    if not hits:
        return model.silent
    at = model.line[0] + model.line[1] * evidence(model, hits)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, at))))


def terms_of(token: str) -> tuple[str, ...]:
    """Candidates for the lexicon that a token is: a word and its stems."""
    word = next(iter(pieces(token)), "")
    if not (2 < len(word) <= LONGEST and word.isalpha()):
        return ()
    return word, *(word[:n] + "*" for n in STEMS if n < len(word))


def signature(tokens: list[str]) -> list[int]:
    """The minimum of the hashes of three words in each of six bins; near copies share most of them."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    h = mix(h[:-2] * np.uint64(31) + h[1:-1] * np.uint64(17) + h[2:], 3) if len(h) > 2 else h
    bins = (h % np.uint64(6)).astype(np.int64)
    return [int(h[bins == i].min(initial=2**64 - 1).view(np.int64)) for i in range(6)]


def copy_groups(signatures: dict[int, list[int]]) -> dict[int, int]:
    """A group for each text of the bounded sample: texts that share three of the six minima are copies."""
    group = {i: i for i in signatures}

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    first: dict[tuple, int] = {}
    for i in sorted(signatures):
        for three in combinations(enumerate(signatures[i]), 3):
            group[top(i)] = top(first.setdefault(three, i))
    return {i: top(i) for i in signatures}


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, text, toxic) of about `rows` labelled documents, chosen by a hash of the id; that bound is why their ids
    may be broadcast. Labels without id or toxic are left out. Of equal texts with equal labels one is taken."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
    total = usable.count()
    few = usable.filter(common.luck(id_col, F.lit(11)) * total < rows).select(
        F.col(id_col).alias("_id"), (F.col("toxic") > 0).alias("toxic"))
    found = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(
        F.broadcast(few), F.col("_doc") == F.col("_id"))
    return (found.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min("_doc").alias("id"), F.first("text").alias("text"))
            .select("id", "text", "toxic"))


def learn_lexicon(train: DataFrame, toxic_rows: int, clean_rows: int) -> tuple[list[str], list[float]]:
    """Terms and their z values; of copies of a toxic text one counts.

    What reaches the driver are the words and stems of at least three toxic texts of the bounded sample and, counted
    by Spark, the clean texts that hold them.
    """
    def toxic_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, ids = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sorted({t for token in set(text.lower().split()) for t in terms_of(token)})
                terms += found
                ids += [i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(ids, pa.int64())], ["term", "id"])

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signature(t.lower().split()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "minima"])

    texts = train.filter("toxic").select("id", "text")
    group = copy_groups({r["id"]: r["minima"] for r in texts.mapInArrow(signatures, "id bigint, minima array<bigint>").collect()})
    toxic = texts.mapInArrow(toxic_terms, "term string, id bigint").groupBy("term").agg(F.collect_list("id").alias("ids"))
    holders = {}
    for r in toxic.filter(F.size("ids") >= LEAST_TEXTS).collect():
        different = {group[i] for i in r["ids"]}
        if len(different) >= LEAST_TEXTS:
            holders[r["term"]] = different
    toxic_rows = len(set(group.values()))
    wanted = train.sparkSession.sparkContext.broadcast(frozenset(holders))

    def clean_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, known = wanted.value, Counter(), {}
        for batch in batches:
            if len(known) > KNOWN:
                known.clear()
            for text in batch.column(0).to_pylist():
                found = set()
                for token in set(text.lower().split()):
                    if token not in known:
                        known[token] = tuple(t for t in terms_of(token) if t in held)
                    found.update(known[token])
                counts.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    clean = train.filter("NOT toxic").select("text").mapInArrow(clean_terms, "term string, n bigint")
    in_clean = {r["term"]: r["n"] for r in clean.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    ranked = {}
    for term, different in holders.items():
        t, c = len(different), in_clean.get(term, 0)
        odds = math.log((t + 0.5) / (toxic_rows - t + 0.5)) - math.log((c + 0.5) / (clean_rows - c + 0.5))
        z = odds / math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if z >= LEAST_Z and t * (toxic_rows + clean_rows) >= LEAST_LIFT * toxic_rows * (t + c):
            ranked[term] = z
    # A stem gives way to a longer form that stands in nearly all of its texts.
    vague = {stem for term in ranked for n in STEMS if (stem := term[:n] + "*") != term and n < len(term.rstrip("*"))
             and stem in ranked and len(holders[term]) >= DEFINITE * len(holders[stem])}
    covered: set = set()
    chosen: dict[str, float] = {}
    for term in sorted(ranked.keys() - vague, key=lambda t: (-ranked[t], -len(t), t)):
        stem = term.rstrip("*")
        # What a term adds to shorter and longer forms of itself that have been taken.
        kin = [holders[o] for o in chosen if o.startswith(stem) or stem.startswith(o.rstrip("*"))]
        if len(holders[term].difference(*kin)) >= LEAST_TEXTS and (ranked[term] >= STRONG_Z or holders[term] - covered):
            chosen[term] = ranked[term]
            covered |= holders[term]
    return list(chosen), list(chosen.values())


def smoothed(counts: dict, above) -> dict:
    """Rates from (toxic, all) counts, each drawn towards the coarser rate `above(key)`."""
    return {k: min(0.995, max(0.005, (t + WEIGHT * above(k)) / (n + WEIGHT))) for k, (t, n) in counts.items()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """The model of the labelled documents. Without labels, or with labels of one kind, no text has hits and all
    get the score 0.05."""
    train = labelled(docs, labels, id_col, text, rows).persist()
    try:
        sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
        toxic_rows, clean_rows = sizes.get(True, 0), sizes.get(False, 0)
        if not toxic_rows or not clean_rows:
            return Model()
        terms, strength = learn_lexicon(train, toxic_rows, clean_rows)
        model = Model(terms, strength, [edits_of(t) for t in terms], base=(toxic_rows + 0.5) / (toxic_rows + clean_rows + 1))
        shared = train.sparkSession.sparkContext.broadcast(model)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value)
            for batch in batches:
                for doc, one, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                    hits = finder.hits(one)
                    yield pa.RecordBatch.from_pydict({
                        "id": [doc] * len(hits), "toxic": [toxic] * len(hits), "form": [h.form for h in hits],
                        "term": [h.term for h in hits], "edits": [h.edits for h in hits],
                        "quoted": [h.quoted for h in hits], "beside": [h.beside for h in hits]}, schema=schema)

        schema = pa.schema([("id", pa.int64()), ("toxic", pa.bool_()), ("form", pa.string()), ("term", pa.int64()),
                            ("edits", pa.int64()), ("quoted", pa.bool_()), ("beside", pa.list_(pa.int64()))])
        found = train.mapInArrow(find, "id bigint, toxic boolean, form string, term bigint, edits bigint, quoted boolean, beside array<bigint>")
        by_doc: dict[tuple[int, bool], list[Hit]] = defaultdict(list)
        for r in found.toLocalIterator():
            by_doc[r["id"], r["toxic"]].append(Hit(r["form"], r["term"], r["edits"], r["quoted"], list(r["beside"])))
    finally:
        train.unpersist()
    weigh(model, by_doc)
    for i in range(len(terms)):
        while model.edits[i] and model.by_term.get((i, model.edits[i]), 1.0) < EDIT_RATE:
            model.edits[i] -= 1
    by_doc = {k: kept for k, hits in by_doc.items() if (kept := [h for h in hits if h.edits <= model.edits[h.term]])}
    regress(model, by_doc, toxic_rows, clean_rows)
    return model


def weigh(model: Model, by_doc: dict[tuple[int, bool], list[Hit]]) -> None:
    """Rates of distances, terms and spellings, and weights of contexts, from the hits of the training texts."""
    term, form = (defaultdict(lambda: [0, 0]) for _ in range(2))
    quoted, beside = np.full((2, 2), 1.0), np.full((2, BUCKETS), 1.0)
    for (_, toxic), hits in by_doc.items():
        for table, keys in ((term, {(h.term, h.edits) for h in hits}), (form, {h.form for h in hits})):
            for key in keys:
                table[key][0] += toxic
                table[key][1] += 1
        for h in hits:
            quoted[int(toxic), int(h.quoted)] += 1
            np.add.at(beside[int(toxic)], h.beside, 1.0)
    term_of = {h.form: (h.term, h.edits) for hits in by_doc.values() for h in hits}
    exact = smoothed({k: v for k, v in term.items() if k[1] == 0}, lambda k: 0.5)
    prior = lambda k: exact.get((k[0], 0), 0.5) * MISSPELLED ** k[1]
    every = {(i, k) for i in range(len(model.terms)) for k in range(model.edits[i] + 1)}
    model.by_term = smoothed({k: term.get(k, (0, 0)) for k in every}, prior)
    model.by_form = smoothed(form, lambda k: model.by_term[term_of[k]])
    share = quoted / quoted.sum(1, keepdims=True)
    model.quoted = float(np.clip(math.log(share[1, 1] / share[0, 1]), -3, 3))
    # Ten of each bucket, split as all context words are, draw rare ones to 0.
    total = beside.sum(1, keepdims=True)
    expected = total / total.sum() * 10
    model.context = np.log((beside[1] + expected[1]) / total[1]) - np.log((beside[0] + expected[0]) / total[0])
    model.context[beside.sum(0) < 12] = 0.0
    model.context = np.clip(model.context - np.average(model.context, weights=beside.sum(0)), -0.5, 0.5)


def regress(model: Model, by_doc: dict[tuple[int, bool], list[Hit]], toxic_rows: int, clean_rows: int) -> None:
    """Logistic regression of the training texts with hits on their evidence, by Newton's method.

    Evidence is a log odds ratio already, so the line is drawn towards slope 1 and the odds of any text.
    """
    toxic = sum(t for _, t in by_doc)
    model.silent = (toxic_rows - toxic + 0.25) / (toxic_rows + clean_rows - len(by_doc) + 5.0)
    x = np.array([[1.0, evidence(model, h)] for h in by_doc.values()]).reshape(-1, 2)
    y = np.array([float(t) for _, t in by_doc])
    aim, firm = np.array([logit(model.base), 1.0]), np.array([0.5, 5.0])
    w = aim.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - firm * (w - aim)
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(firm), gradient)
        w = w + np.clip(change, -1, 1)
        if np.abs(change).max() < 1e-9:
            break
    model.line = float(w[0]), float(w[1])


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", predict: float = PREDICT) -> DataFrame:
    """(id, score, predicted, hits) of every row; whole texts are read.

    `hits` holds (form, term, edits, quoted, strength) of each word or part of a word that may be a term, in the
    order of the text. Null, empty and blank texts have none and get the score of a text without hits. Words are
    parted by white space; runs in scripts without spaces are one word. Repeated rows get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    hit = pa.list_(pa.struct([("form", pa.string()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("strength", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        finder = Finder(own)
        none = score_of(own, [])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [finder.hits(t) for t in part.column(1).to_pylist()]
                scores = [score_of(own, h) if h else none for h in found]
                rows = [[(h.form, own.terms[h.term], h.edits, h.quoted, strength_of(own, h)) for h in hits] for hits in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= predict) for s in scores], pa.int32()),
                     pa.array([[dict(zip(names, r)) for r in one] for one in rows], hit)], [id_col, "score", "predicted", "hits"])

    names = "form", "term", "edits", "quoted", "strength"
    return docs.select(id_col, text).mapInArrow(run, (
        f"`{id_col}` {kind}, score double, predicted int, "
        "hits array<struct<form:string,term:string,edits:int,quoted:boolean,strength:double>>"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` by a model of the labelled ones that are not held out."""
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    out = lambda: F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = fit(docs, labels.filter(~F.coalesce(out(), F.lit(False))))
    return toxicity(docs, model).select("doc_id", out().alias("held_out"), "score", "predicted")
