"""Personal data and secrets replaced by keyed surrogates.

Each kind of entity has a canonical form, so one entity gets one surrogate however and
wherever it is written; the words of a name have surrogates of their own, so a person is one with any title or none. A surrogate is a keyed permutation of the entity's own format:
letters of the same case and script, digits for digits, valid check digits, given names of the same
gender. A permutation keeps different entities different. An entity whose surrogate would
be one that the corpus itself holds gets another, checked against all that are in use.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, map_slices, texts

# Given names by script and gender, and titles by gender.
GIVEN = {
    ("latin", "m"): "james john robert michael william david carlos miguel pierre jean hans karl peter thomas paul mark".split(),
    ("latin", "f"): "mary patricia linda elizabeth susan sarah maria carmen marie claire anna ursula laura julia emma alice".split(),
    ("cyrillic", "m"): "иван пётр алексей дмитрий сергей андрей николай михаил".split(),
    ("cyrillic", "f"): "анна мария елена ольга наталья татьяна ирина екатерина".split(),
}
TITLES = {
    "m": "Mr Mister Sir Herr Señor Monsieur Господин".split(),
    "f": "Mrs Ms Miss Madam Frau Fräulein Señora Señorita Madame Mademoiselle Госпожа".split(),
    "n": "Dr Prof Professor Доктор".split(),
}
CLASSES = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789", "аеёиоуыэюяіїє", "бвгджзйклмнпрстфхцчшщъьґўј",
    "àáâãäåæèéêëìíîïòóôõöøùúûüýÿāăąēėęěīįōőœūůűų", "çćčďđğłľńňñŕřśşšťţźżžþ",
)
#: upper-case letters of Latin, Greek and Cyrillic scripts
_UPPER = "".join(c for c in map(chr, range(0x41, 0x530)) if c.isupper())
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}

EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
#: numbers, longest kinds first; each must stand alone
NUMBERS = re.compile(
    r"(?<![\w.])(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)"
    r"|(?P<card>\d(?:[ -]?\d){12,18})"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<ip>(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?!\.\d)"
    r"|(?P<phone>\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})"
    r")(?!\w)"
)
SECRETS = re.compile(r"(?<![A-Z0-9])(?P<access>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Z0-9])|(?i:\b(?:password|passwd|pwd|token|secret|api_?key)\b\s*[=:]\s*[\"']?)(?P<secret>[A-Za-z0-9+/_~-]{8,})")
#: in lower case, one of them in whatever SECRETS finds
SECRET_HINTS = ("akia", "asia", "password", "passwd", "pwd", "token", "secret", "apikey", "api_key")
NAMES = re.compile(r"\b(?P<title>" + "|".join(sorted(_GENDER, key=len, reverse=True)) + rf")\.? (?P<name>[{_UPPER}][\w'’-]+(?: [{_UPPER}][\w'’-]+)?)")
_DIGIT = re.compile(r"[0-9]")
_LISTED = {n: g for (_, g), names in GIVEN.items() for n in names}


def luhn(digits: str) -> int:
    """The check sum of a card number, 0 if it holds."""
    return sum(d if i % 2 == 0 else (2 * d) // 10 + (2 * d) % 10 for i, d in enumerate(map(int, reversed(digits)))) % 10


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def entities(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of each entity, in order and without overlap; of overlapping ones the first found by rank of kind."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*m.span(), "email") for m in EMAIL.finditer(text)]
    low = text.lower().replace("ı", "i").replace("ſ", "s").replace("\u0307", "")  # letters that SECRETS takes for i and s
    if any(h in low for h in SECRET_HINTS):
        found += [(*m.span(m.lastgroup), m.lastgroup) for m in SECRETS.finditer(text) if sum(map(str.isalnum, m[m.lastgroup])) > 3]
    if _DIGIT.search(text):
        for m in NUMBERS.finditer(text):
            if m.lastgroup == "iban" and iban_rest(m[0].replace(" ", "")) != 1 or m.lastgroup == "card" and luhn(re.sub(r"\D", "", m[0])):
                continue  # a number that its check digits deny is none of these
            found.append((*m.span(), m.lastgroup))
    if any(t in text for t in _GENDER):
        titled = [(*m.span("name"), "name") for m in NAMES.finditer(text)]
        found += titled
        # the same people without their titles: by full name or by family name
        people = {text[a:b] for a, b, _ in titled}
        people |= {x.rpartition(" ")[2] for x in people if x.rpartition(" ")[2].lower() not in _LISTED}
        if people:
            again = re.compile(r"(?<![\w'’-])(?:" + "|".join(re.escape(x) for x in sorted(people, key=lambda x: (-len(x), x))) + r")(?![\w'’-])")
            found += [(*m.span(), "name") for m in again.finditer(text)]
    end = 0
    taken: list[tuple[int, int, str]] = []
    for rank, (a, b, kind) in sorted(enumerate(found)):
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, kind))
    for a, b, kind in sorted(taken):
        if a >= end:
            yield a, b, kind
            end = b


def canonical(kind: str, written: str) -> str:
    """What is the same for all ways to write one entity."""
    if kind in ("email", "name", "given", "family"):
        return written.lower()
    if kind in ("card", "ssn", "phone"):
        return re.sub(r"\D", "", written)
    return written.replace(" ", "") if kind == "iban" else written


def parts(kind: str, written: str) -> list[tuple[str, str]]:
    """(kind, written) of what gets a surrogate of its own: a name's words, so a person stays one with or without a title and given name."""
    if kind != "name":
        return [(kind, written)]
    given, _, family = written.partition(" ")
    if family:
        return [("given", given), ("family", family)]
    return [("given" if given.lower() in _LISTED else "family", given)]


class Surrogates:
    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, turn: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{turn}|{half}|{tweak}".encode(), key=self.key, digest_size=32).digest(), "big")

    def number(self, tweak: str, value: int, size: int) -> int:
        """A keyed permutation of 0 to size - 1: a Feistel network, walked until it is inside."""
        if size < 2:
            return value
        bits = (size - 1).bit_length()
        low = bits // 2
        high = bits - low
        while True:
            left, right, a, b = value >> low, value & ((1 << low) - 1), high, low
            for turn in range(8):
                left, right, a, b = right, left ^ (self._round(tweak, turn, right) & ((1 << a) - 1)), b, a
            value = (left << b) | right
            if value < size:
                return value

    def letters(self, tweak: str, word: str, classes: tuple[str, ...] = CLASSES) -> str:
        """A permutation of the words with the same classes of letters at the same places; other characters stay."""
        sets = [next((c for c in classes if x.lower() in c), "") for x in word]
        value, size = 0, 1
        for x, c in zip(word, sets):
            if c:
                value, size = value * len(c) + c.index(x.lower()), size * len(c)
        shape = "".join(str(classes.index(c)) if c else x for x, c in zip(word, sets))
        value = self.number(f"{tweak}|{shape}", value, size)
        out = []
        for x, c in zip(reversed(word), reversed(sets)):
            if c:
                value, k = divmod(value, len(c))
                y = c[k]
                out.append(y.upper() if x.isupper() else y)
            else:
                out.append(x)
        return "".join(reversed(out))

    def next(self, kind: str, own: str) -> str:
        """The canonical form that takes the place of a canonical form."""
        if kind == "email":
            name, _, host = own.rpartition("@")
            labels = host.split(".")
            shown = [self.letters("host", x, ("abcdefghijklmnopqrstuvwxyz", "0123456789")) for x in labels[:-1]]
            return self.letters("email", name, ("abcdefghijklmnopqrstuvwxyz", "0123456789")) + "@" + ".".join([*shown, labels[-1]])
        if kind == "ip":
            value = 0
            for x in own.split("."):
                value = value * 256 + int(x)
            value = self.number("ip", value, 1 << 32)
            return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
        if kind == "card":
            valid, out = luhn(own) == 0, own
            while True:  # among those of the same first digit, length and validity
                out = own[0] + str(self.number(f"card{len(own)}{own[0]}", int(out[1:]), 10 ** (len(own) - 1))).zfill(len(own) - 1)
                if (luhn(out) == 0) == valid:
                    return out
        if kind == "phone":
            keep = max(0, len(own) - 9)
            return own[:keep] + str(self.number(f"phone{own[:keep]}", int(own[keep:]), 10 ** (len(own) - keep))).zfill(len(own) - keep)
        if kind == "ssn":
            return str(self.number("ssn", int(own), 10**9)).zfill(9)
        if kind == "iban":
            body = self.letters("iban", own[4:], ("ABCDEFGHIJKLMNOPQRSTUVWXYZ".lower(), "0123456789"))
            return f"{own[:2]}{98 - iban_rest(own[:2] + '00' + body):02d}{body}"
        if kind == "given":
            return self.given(own)
        if kind == "family":
            return self.letters("family", own)
        if kind == "access":
            return own[:4] + self.letters("access", own[4:], ("ABCDEFGHIJKLMNOPQRSTUVWXYZ".lower(), "0123456789"))
        return self.mixed("secret", own)

    def mixed(self, tweak: str, word: str) -> str:
        classes = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
        sets = [next((c for c in classes if x in c), "") for x in word]
        value, size = 0, 1
        for x, c in zip(word, sets):
            if c:
                value, size = value * len(c) + c.index(x), size * len(c)
        value = self.number(tweak + "|" + "".join(str(classes.index(c)) if c else x for x, c in zip(word, sets)), value, size)
        out = []
        for x, c in zip(reversed(word), reversed(sets)):
            if c:
                value, k = divmod(value, len(c))
            out.append(c[k] if c else x)
        return "".join(reversed(out))

    def given(self, name: str) -> str:
        """Another name of the same list, so of the same gender and script; names off the lists keep off them."""
        for names in GIVEN.values():
            if name in names:
                return names[self.number(f"given{names[0]}", names.index(name), len(names))]
        out = self.letters("given", name)
        while out in _LISTED:
            out = self.letters("given", out)
        return out

    @staticmethod
    def write(kind: str, written: str, form: str) -> str:
        """A canonical form in the manner of what it replaces: its punctuation, spaces and capitals."""
        if kind in ("card", "ssn", "phone", "iban"):
            rest = iter(form)
            return "".join(next(rest) if x.isalnum() else x for x in written)
        if kind in ("email", "given", "family"):
            return _capitals(written, form) if kind != "email" or len(form) == len(written) else form
        return form


def _capitals(like: str, word: str) -> str:
    if len(like) == len(word):
        return "".join(y.upper() if x.isupper() else y for x, y in zip(like, word))
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word


def corpus_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, form) of each different entity of the corpus."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = {(k, canonical(k, w)) for t in (x.decode() for x in texts(batch.column(0))) for a, b, kind in entities(t) for k, w in parts(kind, t[a:b])}
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([f for _, f in found], pa.string())], names=["kind", "form"])

    return map_slices(docs.select(text_col), 0, "kind string, form string", run).distinct()


#: Rounds after which a surrogate may be a letter longer than its entity, where the kind allows it, and after which the search gives up.
WIDEN, ROUNDS = 8, 64


def exceptions(known: DataFrame, key: bytes, written: Written) -> DataFrame | None:
    """(kind, form, stand_in) of those entities whose first surrogates are entities of the corpus themselves; None if there are none.

    They propose the results of further permutations, one a round, until each has one that is neither an entity nor taken.
    Given names are few and shared by many people, so they may stand in for each other. Raises if a format has no room left.
    """

    def proposed(df: DataFrame, turn: int) -> DataFrame:
        def run(batches):
            maker = Surrogates(key + b"|%d" % turn if turn else key)
            for batch in batches:
                forms = []
                for k, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    wide = turn > WIDEN and k in ("email", "family", "secret")
                    forms.append(maker.next(k, "ab"[turn % 2] + f if wide else f))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], names=["kind", "form", "stand_in"])

        return df.select("kind", "form").mapInArrow(run, "kind string, form string, stand_in string")

    by = ["kind", "stand_in"]
    known = known.where("kind <> 'given'")
    entity = known.select("kind", F.col("form").alias("stand_in"))
    first = written(proposed(known, 0))
    waiting = written(first.join(entity, by, "left_semi"))
    if not waiting.limit(1).count():
        return None
    used, found, turn = first.join(entity, by, "left_anti").select(by), None, 0
    while waiting.limit(1).count():
        turn += 1
        if turn > ROUNDS:
            raise ValueError(f"no surrogate is left for entities such as those of kind {waiting.first().kind}")
        now = written(proposed(waiting, turn))
        free = now.join(used.union(entity.select(by)), by, "left_anti")
        # of two that propose one form, as permutations of different lengths may, the least gets it
        free = written(free.groupBy(by).agg(F.min("form").alias("form")).select("kind", "form", "stand_in"))
        waiting = written(now.join(free, ["kind", "form"], "left_anti"))
        used = used.union(free.select(by))
        found = free if found is None else found.union(free)
    return found


def replace(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = "n_entities", length_col: str | None = None) -> DataFrame:
    """docs with every entity of text_col replaced; count_col tells how many, length_col (if given) becomes the new length.

    Null texts stay null; texts without entities stay as they are. Repeated rows are treated each alike;
    a column of docs named count_col is replaced.
    """
    spark = docs.sparkSession
    written = Written(spark)
    known = written(corpus_entities(docs, text_col))
    special = exceptions(known, key, written)
    names = [c for c in docs.columns if c != count_col]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text_col)
    walks = special is not None
    if walks:
        docs = _with_exceptions(docs, special, text_col, "".join(names) + "_")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        maker, memo, out, counts = Surrogates(key), {}, [], []
        column = batch.column(at)
        nulls = column.is_null().to_pylist()
        walked = batch.column(len(names)).to_pylist() if walks else [None] * batch.num_rows
        for t, none, pairs in zip(texts(column), nulls, walked):
            if none:
                out.append(None)
                counts.append(0)
                continue
            text, pieces, end, n = t.decode(), [], 0, 0
            own = dict(pairs or ())
            for a, b, kind in entities(text):
                shown = []
                for part, word in parts(kind, text[a:b]):
                    form = canonical(part, word)
                    new = own.get(f"{part} {form}")
                    if new is None:
                        if (part, form) not in memo:
                            memo[part, form] = maker.next(part, form)
                        new = memo[part, form]
                    shown.append(maker.write(part, word, new))
                pieces += [text[end:a], " ".join(shown)]
                end, n = b, n + 1
            out.append("".join([*pieces, text[end:]]) if pieces else text)
            counts.append(n)
        columns = [pa.array(out, column.type) if i == at else batch.column(i) for i in range(len(names))]
        if length_col in names:
            old = batch.column(names.index(length_col))
            lengths = [o if x is None or not n else len(x) for o, x, n in zip(old.to_pylist(), out, counts)]
            columns[names.index(length_col)] = pa.array(lengths, old.type)
        if count_col:
            columns.append(pa.array(counts, pa.int64()))
        return pa.RecordBatch.from_arrays(columns, names=[*names, *([count_col] if count_col else [])])

    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + (f", `{count_col}` long" if count_col else "")
    return map_slices(docs, at, schema, run)


def _with_exceptions(docs: DataFrame, special: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with a map of the stand-ins that differ from the first surrogate, for the texts that need one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        shas, kinds, forms = [], [], []
        for raw in texts(batch.column(0)):
            t = raw.decode()
            for kind, form in {(k, canonical(k, w)) for a, b, whole in entities(t) for k, w in parts(whole, t[a:b])}:
                shas.append(hashlib.sha256(raw).digest())
                kinds.append(kind)
                forms.append(form)
        return pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()), pa.array(kinds, pa.string()), pa.array(forms, pa.string())], names=["_sha", "kind", "form"])

    held = map_slices(docs.select(text_col), 0, "_sha binary, kind string, form string", run).distinct().join(special, ["kind", "form"])
    maps = held.groupBy("_sha").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(" ", "kind", "form"), "stand_in"))).alias(name))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no name of docs can clash
    sha = F.unhex(F.sha2(F.coalesce(F.col(f"c{docs.columns.index(text_col)}"), F.lit("")).cast("binary"), 256))
    return plain.withColumn("_sha", sha).join(maps, "_sha", "left").select(*plain.columns, name).toDF(*docs.columns, name)
