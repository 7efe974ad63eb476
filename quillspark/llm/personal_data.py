"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns find e-mail addresses, IP addresses, card numbers (with a right check digit) and phone numbers. They miss a
card number whose check digit is wrong, numbers without a plus, and whatever stands so close to other numbers that a
pattern takes both. The field scores whole candidate spans (their groups of digits, separators, neighbours, cue words),
and dynamic programming over spans of at most `LONGEST` tokens chooses boundaries and kinds jointly. What it finds is
added; what the patterns find stays.

The field is trained in plain Python by stochastic gradients of its log-likelihood, on invented entities and look-alikes
put between words of a bounded sample of documents, and on what the patterns find in that sample. It is a small table of
weights, which every task gets; documents are then worked on one by one, and no row moves between machines.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(1, 5)
#: Bounds of the sample that the field learns from: documents, and letters of each.
SAMPLE, SAMPLE_CHARS = 1000, 20_000
#: Tokens of a span at most, and groups of digits; invented training texts; passes over them.
LONGEST, GROUPS, EXAMPLES, PASSES = 20, 7, 1500, 6

# ---- fixed patterns

# What each kind looks like. A run is looked at from its start only, so that time is linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the patterns find, by kind and start."""
    found, last = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        at = start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            last = m.end()
            found.append((EMAIL, start, last))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            found.append((IP, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = "".join(_DIGIT.findall(m.group()))
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((CARD, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            found.append((PHONE, *m.span()))
    return found


# ---- zones, candidate spans and their features

_TAIL = re.compile(r"[0-9@]\S*")
_TOKEN = re.compile(r"[^\W_]+|.", re.DOTALL)
_GROUPS = re.compile(r"[0-9]+")
_FORMS = ((IP, re.compile(r"[0-9]+(?:\.[0-9]+){3}")), (CARD, re.compile(r"[0-9]+(?:[ -][0-9]+)*")), (PHONE, re.compile(r"[+(]?[0-9][0-9 ().-]*[0-9]")))
_DIGITS = {IP: (4, 12), CARD: (12, 19), PHONE: (7, 15)}
#: Words before a number that tell what it is, or that it is something else.
CUES = frozenset("tel phone call fax mobile cell telefon teléfono téléphone card visa mastercard credit debit karte tarjeta carte ip host server address mail email token key password secret id order ref isbn version serial build date".split())


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Runs of blank-parted pieces with digits or an at sign, joined by single blanks, that can hold an entity."""
    low = high = None

    def full(low: int, high: int) -> bool:
        return "@" in text[low:high] or len(_DIGIT.findall(text, low, high)) >= 4

    for m in _TAIL.finditer(text):
        start = m.start()
        while start > (high or 0) and not text[start - 1].isspace():
            start -= 1
        if high is not None and start == high + 1 and text[high] == " ":
            high = m.end()
            continue
        if high is not None and full(low, high):
            yield low, high
        low, high = start, m.end()
    if high is not None and full(low, high):
        yield low, high


def _class(text: str, at: int) -> str:
    if at < 0 or at >= len(text):
        return ""
    c = text[at]
    return "9" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c


def features(text: str, start: int, end: int, kind: int, groups: list[str]) -> list[str]:
    """What a whole span looks like: its groups of digits, separators, neighbours, and the words before it."""
    span, name = text[start:end], KINDS[kind - 1]
    near = text[max(0, start - 24) : start].lower()
    before, after = _class(text, start - 1), _class(text, end)
    out = ["", f"<{before}", f">{after}", *(f"w{w}" for w in re.findall(r"[^\W\d_]+", near)[-2:] if w in CUES)]
    if before not in ("", "_", "a", "9") and _class(text, start - 2) == "9" or before == "9":
        out.append("<cut")
    if after not in ("", "_", "a", "9") and _class(text, end + 1) == "9" or after == "9":
        out.append(">cut")
    if before == "_" and _class(text, start - 2) == "9":
        out.append("<more")
    if after == "_" and _class(text, end + 1) == "9":
        out.append(">more")
    if kind == EMAIL:
        local, domain = span.split("@")
        out += [f".{'.' in domain}", f"l{min(len(local), 3)}", f"t{domain.rpartition('.')[2].isalpha()}"]
    else:
        n = sum(map(len, groups))
        out += [f"d{n}", f"n{len(groups)}", "g" + "-".join(str(len(g)) for g in groups), "s" + "".join(sorted({c for c in span if not c.isdigit()})), f"a{_class(span, 0)}", f"x{max(map(len, groups))}"]
        if kind == CARD:
            out += [f"L{luhn(''.join(groups))}", f"f{groups[0][0]}"]
        if kind == IP:
            out += [f"v{all(len(g) <= 3 and int(g) <= 255 for g in groups)}", f"z{any(len(g) > 1 and g[0] == '0' for g in groups)}"]
        if kind == PHONE:
            out += [f"f{span.count('(') == span.count(')')}", f"b{'  ' in span or '--' in span or '..' in span}", f"p{groups[0][0] if span[0] == '+' else ''}"]
    return [name + x for x in out]


class Zone:
    """The tokens of a zone, and its candidate spans: (first token, token after the last, kind, features)."""

    def __init__(self, text: str, low: int, high: int) -> None:
        self.tokens = [m.span() for m in _TOKEN.finditer(text, low, high)]
        self.candidates = list(self._candidates(text, "@" in text[low:high]))

    def _candidates(self, text: str, mail: bool) -> Iterator[tuple[int, int, int, list[str]]]:
        tokens = self.tokens
        for i, (start, _) in enumerate(tokens):
            if not (text[start].isalnum() or text[start] in "+("):
                continue
            digits, parts, signs, numeric, spaced = 0, 0, 0, True, False
            for j in range(i, min(len(tokens), i + LONGEST)):
                a, end = tokens[j]
                c = text[a]
                if c.isalnum():
                    if (piece := text[a:end]).isascii() and piece.isdigit():
                        digits, parts = digits + end - a, parts + 1
                    else:
                        numeric = False
                elif c == "@":
                    numeric, signs = False, signs + 1
                elif c in " ()":
                    spaced = True
                elif c not in "._%+-" or (c in "_%" and not mail):
                    break
                if not numeric and (spaced or not mail or signs > 1) or (numeric and (digits > 19 or parts > GROUPS) and not mail):
                    break
                if not c.isalnum():
                    continue
                if not numeric:
                    if signs == 1 and text[start].isalnum():
                        yield i, j + 1, EMAIL, features(text, start, end, EMAIL, [])
                elif 4 <= digits <= 19:
                    span = text[start:end]
                    groups = _GROUPS.findall(span)
                    for kind, form in _FORMS:
                        if _DIGITS[kind][0] <= digits <= _DIGITS[kind][1] and form.fullmatch(span):
                            yield i, j + 1, kind, features(text, start, end, kind, groups)


# ---- the field


class Field:
    """Weights of a span's features, and of one segment's kind (0: a token outside of entities) after another's."""

    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.weights = weights or {}

    def score(self, names: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in names)

    def transitions(self) -> list[list[float]]:
        return [[self.weights.get(f"{a}->{b}", 0.0) for b in range(5)] for a in range(5)]

    def best(self, zone: Zone) -> list[tuple[int, int, int]]:
        """(first token, token after the last, kind) of the entities of the best segmentation."""
        if not zone.candidates:
            return []
        n, move = len(zone.tokens), self.transitions()
        ends = defaultdict(list)
        for i, j, kind, names in zone.candidates:
            ends[j].append((i, kind, self.score(names)))
        value = [[-math.inf] * 5 for _ in range(n + 1)]
        value[0][0] = 0.0
        back: list[list] = [[None] * 5 for _ in range(n + 1)]
        for j in range(1, n + 1):
            for i, kind, score in ((j - 1, 0, 0.0), *ends[j]):
                for before in range(5):
                    v = value[i][before] + move[before][kind] + score
                    if v > value[j][kind]:
                        value[j][kind], back[j][kind] = v, (i, before)
        j, kind, out = n, max(range(5), key=value[n].__getitem__), []
        while j:
            i, before = back[j][kind]
            if kind:
                out.append((i, j, kind))
            j, kind = i, before
        return out[::-1]

    def gradient(self, zone: Zone, gold: set[tuple[int, int, int]]) -> tuple[float, dict[str, float]]:
        """Log-likelihood of a segmentation, and what it grows by with each weight."""
        n, move = len(zone.tokens), self.transitions()
        arcs = [(t, t + 1, 0, ()) for t in range(n)] + zone.candidates
        scores = [self.score(names) for *_, names in arcs]
        into, out = defaultdict(list), defaultdict(list)
        for k, (i, j, _, _) in enumerate(arcs):
            into[j].append(k)
            out[i].append(k)

        def total(values: list[float]) -> float:
            top = max(values)
            return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))

        ahead = [[-math.inf] * 5 for _ in range(n + 1)]
        ahead[0][0] = 0.0
        for j in range(1, n + 1):
            for kind in range(5):
                sums = [ahead[arcs[k][0]][b] + move[b][kind] + scores[k] for k in into[j] if arcs[k][2] == kind for b in range(5)]
                ahead[j][kind] = total(sums) if sums else -math.inf
        behind = [[-math.inf] * 5 for _ in range(n + 1)]
        behind[n] = [0.0] * 5
        for i in range(n - 1, -1, -1):
            for b in range(5):
                behind[i][b] = total([move[b][arcs[k][2]] + scores[k] + behind[arcs[k][1]][arcs[k][2]] for k in out[i]])
        all_paths = total(ahead[n])
        grown, likelihood = defaultdict(float), -all_paths
        for k, (i, j, kind, names) in enumerate(arcs):
            share = 0.0
            for b in range(5):
                x = ahead[i][b] + move[b][kind] + scores[k] + behind[j][kind] - all_paths
                if x > -40:
                    share += math.exp(x)
                    grown[f"{b}->{kind}"] -= math.exp(x)
            for f in names:
                grown[f] -= share
        before, at = 0, 0
        ends = {i: (j, kind) for i, j, kind in gold}
        by_span = {(i, j, kind): k for k, (i, j, kind, _) in enumerate(arcs)}
        while at < n:
            j, kind = ends.get(at, (at + 1, 0))
            k = by_span[at, j, kind]
            likelihood += move[before][kind] + scores[k]
            grown[f"{before}->{kind}"] += 1
            for f in arcs[k][3]:
                grown[f] += 1
            before, at = kind, j
        return likelihood, grown


# ---- training


def _number(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _entity(r: random.Random) -> tuple[int, str]:
    kind, n = r.choice((EMAIL, IP, IP, CARD, CARD, CARD, PHONE, PHONE, PHONE)), lambda k: _number(r, k)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8)))
    if kind == EMAIL:
        return kind, f"{word()}{r.choice(('', '.' + word(), '.' + n(2), '_' + word(), '+' + word()))}@{word()}{r.choice(('', n(1), '-' + word()))}{r.choice(('', '.' + word()))}.{r.choice(('com', 'org', 'net', 'de', 'fr', 'es', 'io'))}"
    if kind == IP:
        return kind, ".".join(str(r.randint(0 if k else 1, 255)) for k in range(4))
    if kind == CARD:
        digits = r.choice("3456") + n(r.choice((15, 15, 15, 15, 14, 12, 13, 17, 18)))
        if r.random() < 0.4:
            digits = next(d for d in (digits[:-1] + x for x in "0123456789") if luhn(d))
        sep = r.choice(("", "", "", " ", "-"))
        if len(digits) == 15 and sep:
            return kind, sep.join((digits[:4], digits[4:10], digits[10:]))
        return kind, sep.join(digits[k : k + 4] for k in range(0, len(digits), 4)) if sep and len(digits) == 16 else digits
    country = r.choice(("1", "1", "44", "49", "33", "34", "7", "420"))
    a, b, c = r.choice("23456789") + n(2), n(3), n(4)
    return kind, r.choice((f"+{country} ({a}) {b}-{c}", f"+{country} ({a}) {b}-{c}", f"+{country} {a} {b} {c}", f"+{country}-{a}-{b}-{c}", f"+{country}{a}{b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{country} {a}{n(1)} {b}{c}", f"+{country}.{a}.{b}.{c}"))


def _lookalike(r: random.Random) -> str:
    n, code = lambda k: _number(r, k), lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    year = f"{r.randint(1900, 2039)}"
    day = f"{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
    return r.choice((
        code(40), code(18), "AKIA" + code(16).upper(), f"{code(8)}-{code(4)}-{code(4)}-{code(4)}-{code(12)}", f'"{code(32)}"', f"{year}-{day}", f"{year}-{day} {n(2)}:{n(2)}:{n(2)}", f"{year}-{day}T{n(2)}:{n(2)}:{n(2)}Z", f"{year}{day.replace('-', '')}",
        f"{n(1)}.{n(9)}", f"{n(2)}.{n(6)} {n(1)}.{n(8)}", f"{n(3)},{n(3)},{n(3)}", f"{n(3)} {n(3)}", f"v{n(1)}.{n(2)}.{n(1)}", f"{n(1)}.{n(1)}.{n(5)}.{n(1)}", f"{r.randint(256, 999)}.{n(3)}.{n(3)}.{r.randint(256, 999)}", f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"978{n(10)}",
        n(7), n(8), n(9), n(10), n(11), "0" * 4 + n(8), n(r.randint(20, 40)), f"{year}-{int(year) + 5} {year}", f"{n(3)} {n(2)} {n(4)} {n(1)} {n(3)}", f"{n(5)}-{n(4)}", f"{n(4)}/{n(8)}", f"#{n(8)}", f"{n(2)}:{n(2)}:{n(2)}.{n(6)}", f"@{code(6)}", f"{n(2)}.{n(2)}.{year}", f"{n(4)}x{n(4)}",
        " ".join(n(r.randint(1, 3)) for _ in range(r.randint(5, 16))), " ".join(n(r.randint(1, 6)) for _ in range(r.randint(3, 8))), " ".join(f"{n(1)}.{n(2)}" for _ in range(r.randint(3, 8))),
    ))


def _examples(texts: list[str], count: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Invented entities and look-alikes between words of the texts: each text with the spans of its entities."""
    r = random.Random(seed)
    words = [w for t in texts for w in re.findall(r"[^\W\d_]+", t)[:200]] or "the of and to in a is that for it as was with be by on not he his but".split()
    for _ in range(count):
        text, gold = " ".join(r.choice(words) for _ in range(r.randint(0, 5))), []
        for _ in range(r.choice((1, 1, 1, 2, 2, 3))):
            kind, item = _entity(r) if r.random() < 0.6 else (0, _lookalike(r))
            text += r.choice((" ",) * 10 + (", ", ": ", ". ", "\n", " (", '="', "=", "; ")) if text else ""
            if kind == 0 and r.random() < 0.2 or kind and r.random() < 0.1:
                text += r.choice(("token", "id", "order", "version") if not kind else ("mail", "ip", "card", "phone", "tel")) + r.choice((" ", ": ", "=", " = "))
            if kind:
                gold.append((kind, len(text), len(text) + len(item)))
            text += item + r.choice(("",) * 8 + (".", ",", ")", '"'))
        yield text + r.choice(("", " ", "\n")) + " ".join(r.choice(words) for _ in range(r.randint(0, 4))), gold


def _labelled(text: str, gold: list[tuple[int, int, int]], unsure: bool) -> Iterator[tuple[Zone, set[tuple[int, int, int]]]]:
    """Zones with their gold segments. unsure: leave out zones that hold candidates off the gold spans."""
    for low, high in zones(text):
        zone = Zone(text, low, high)
        if not zone.candidates:
            continue
        starts, ends = {a: k for k, (a, _) in enumerate(zone.tokens)}, {b: k + 1 for k, (_, b) in enumerate(zone.tokens)}
        spans = {(starts[a], ends[b], kind) for kind, a, b in gold if a in starts and b in ends}
        spans &= {(i, j, kind) for i, j, kind, _ in zone.candidates}
        taken = {t for i, j, _ in spans for t in range(i, j)}
        if sum(j - i for i, j, _ in spans) > len(taken):
            continue
        if unsure and any(not taken & set(range(i, j)) for i, j, _, _ in zone.candidates):
            continue
        yield zone, spans


def train(texts: list[str], examples: int = EXAMPLES, passes: int = PASSES, seed: int = 13, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """A field that has learnt from the texts (see above); the same texts in the same order give the same field."""
    data = [x for text, gold in _examples(texts, examples, seed) for x in _labelled(text, gold, False)]
    natural = [x for text in texts for x in _labelled(text, base_spans(text), True)]
    data += natural[:examples]
    field, seen, r = Field(), defaultdict(float), random.Random(seed)
    w = field.weights
    for _ in range(passes):
        r.shuffle(data)
        for zone, gold in data:
            for f, g in field.gradient(zone, gold)[1].items():
                g -= decay * w.get(f, 0.0)
                if g:
                    seen[f] += g * g
                    w[f] = w.get(f, 0.0) + rate * g / math.sqrt(seen[f] + 1e-6)
    return field


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Field:
    """A field trained on at most `rows` documents of at most `chars` letters, those of the least hashes of their ids.

    Nothing of a longer text is read for training. Null and empty texts teach nothing; of an empty table the field learns
    from invented texts alone. The sample depends on ids and texts alone, not on how the table is stored.
    """
    short = docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("text")).filter((F.length("text") > 0) & (F.length("text") <= chars))
    # Which hashes are in is settled before any text moves.
    last = short.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return train([r.text for r in short.filter(F.col("h") <= last).orderBy("h", "text").limit(rows).collect()] if last is not None else [])


# ---- documents


def entities(text: str, field: Field) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, whether a pattern found it), by kind, start and end. Added spans meet no pattern's of their kind."""
    base = base_spans(text)
    found = [(*s, True) for s in base]
    ends = {k: [b for kind, _, b in base if kind == k] for k in range(1, 5)}
    starts = {k: [a for kind, a, _ in base if kind == k] for k in range(1, 5)}

    def met(kind: int, start: int, end: int) -> bool:
        at = bisect_right(ends[kind], start)
        return at < len(ends[kind]) and starts[kind][at] < end

    for low, high in zones(text):
        zone = Zone(text, low, high)
        for i, j, kind in field.best(zone):
            start, end = zone.tokens[i][0], zone.tokens[j - 1][1]
            if not met(kind, start, end):
                found.append((kind, start, end, False))
    return sorted(found)


_SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def personal_data(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and spans of each row; a span's start and end count code points, its end is exclusive.

    Null and empty texts have no spans; repeated rows have the same; other columns are left out; an empty table gives no
    rows. Texts are read whole, in time linear in their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field.weights)
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(shared.value)
        for batch in slices(batches):
            rows = [[(KINDS[k - 1], a, b, base) for k, a, b, base in entities(text or "", model)] for text in batch.column("text").to_pylist()]
            rows = [[dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in r] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(rows, struct)], ["doc_id", "text", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, f"doc_id long, text string, spans {_SPANS}")


def masked(found: DataFrame, mark: str = "<{}>") -> DataFrame:
    """doc_id and text of personal_data()'s rows with each span replaced by a mark of its kind; of spans that overlap, by the first's."""
    marks = F.create_map(*[F.lit(x) for k in KINDS for x in (k, mark.format(k))])
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(done: Column, s: Column) -> Column:
        fresh = F.concat(done["text"], F.substring(F.col("text"), (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")), marks[s["kind"]])
        text = F.when(s["start"] >= done["at"], fresh).otherwise(done["text"])
        return F.struct(text.alias("text"), F.greatest(done["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    rest = lambda done: F.concat(done["text"], F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.length("text")))
    return found.select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(F.aggregate(by_start, start, step, rest)).alias("text"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, how many spans of each kind the patterns find, a digest of those, and all spans."""
    found = personal_data(docs, fit(docs, id_col, text_col), id_col, text_col)
    base = F.filter("spans", lambda s: s["base"])
    counted = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(counted, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
