"""Surrogates for personal data: keyed, type-consistent replacements with checks for collisions.

An entity is a kind and a canonical form (an e-mail in lower case, the digits of a phone number, a person's
names folded), so all its mentions, in all documents, get one surrogate (coreference), written in the format of
each mention. The mentions of persons in a text are clustered first: a title and a family name, initials and a
lone given or family name belong to the fuller name they agree with. The surrogate is drawn by HMAC from key,
kind, canonical form and an attempt number. Distinct entities must stay distinct and no surrogate may be another
entity of the corpus: candidates are checked in tables, and those that collide draw again with the next attempt
until none does. Almost all entities end with attempt 0, which every task can compute by itself; only the
exceptions travel back to their documents.

Names need no list: a title or a listed given name tells a person, but so does the shape of two or three
capitalised words, if none of them is written in lower case anywhere in the corpus (decided by a join).
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import zip_longest

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm import common

#: Given names by script and gender; a surrogate has the same script and gender.
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Carla Clara Claire Diana Elena Emma Eva Frida Greta Hanna Helen Ines Irene Julia Karin Laura Lena "
    "Lucia Maria Marta Mary Nina Olga Paula Petra Rosa Sara Sofia Susan Teresa Ursula Vera Zoe".split(),
    ("latin", "m"): "Adam Albert Anton Bruno Carl David Diego Emil Erik Felix Frank George Hans Hugo Ivan Jacob James John Jorge Karl "
    "Leo Louis Lukas Marco Martin Max Michael Oscar Otto Paul Pedro Peter Robert Simon Thomas Victor".split(),
    ("cyrillic", "f"): "Алина Анна Вера Дарья Елена Ирина Лариса Мария Наталья Нина Ольга Полина София Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Антон Борис Виктор Дмитрий Иван Максим Михаил Никита Николай Олег Павел Сергей".split(),
}
#: Family names by script (Cyrillic ones in the male form; the female form adds a letter).
FAMILY = {
    "latin": "Adler Baker Berger Blanc Carter Costa Dubois Fischer Garcia Gomez Hill Keller Lambert Lang Lopez Martin Meyer Moore Moreau "
    "Morris Novak Parker Perez Reed Rossi Roux Sanders Schmidt Silva Smith Taylor Torres Turner Vidal Weber Wolf".split(),
    "cyrillic": "Андреев Беляев Волков Егоров Иванов Ковалёв Козлов Макаров Морозов Новиков Орлов Павлов Петров Соколов".split(),
}
#: Titles that announce a name, folded, with the gender they tell (u: none).
TITLES = {
    "mr": "m", "mister": "m", "herr": "m", "herrn": "m", "señor": "m", "sr": "m", "don": "m", "monsieur": "m", "г-н": "m", "господин": "m",
    "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "señora": "f", "sra": "f", "srta": "f", "doña": "f", "madame": "f", "mme": "f", "mlle": "f",
    "г-жа": "f", "госпожа": "f", "dr": "u", "prof": "u", "professor": "u",
}
#: Words that begin a sentence and never a name.
STARTERS = set(
    "a an and as at but by for from he her his i if in is it my of on or our she so that the their then there they this to was we when with you your dear "
    "am an auf aus bei das dem den der des die ein eine er es für ich im ist mit nach sie und von wir zu "
    "au avec ce cette dans de des du elle en et il ils je la le les mais nous par pour que sur un une vous "
    "con de del el ella en es la las los no para pero por que se sin su un una y "
    "а в и из к на не но о он она они от по с у что это я".split()
)
GENDER = {name.casefold(): gender for (_, gender), names in GIVEN.items() for name in names}

#: From this attempt on an e-mail address leaves its domain's surrogate, and signs of a secret are drawn too.
MOVE = 2
#: After each so many attempts a draw gets longer: by a family name, a digit or a letter.
WIDEN = 16
#: Attempt of a name that is none: its mentions stay.
LEAVE = -1

def _capitals() -> str:
    return "".join(chr(c) for span in ((0x41, 0x250), (0x400, 0x530)) for c in range(*span) if chr(c).isupper())


_UPPER = f"[{_capitals()}]"
_WORD = rf"{_UPPER}(?:(?:['’-](?!s\b))?[^\W\d_])+"
_INITIAL = rf"{_UPPER}\.(?:-?{_UPPER}\.)*(?!\w)|{_UPPER}(?= {_UPPER})(?![^\W\d_])"
_TITLE = rf"(?i:{'|'.join(sorted(map(re.escape, TITLES), key=lambda n: (-len(n), n)))})\.?(?= {_UPPER})"
_TOKEN = rf"(?:{_TITLE}|{_INITIAL}|{_WORD})"
_FIRST = "".join(sorted({t[0] for t in TITLES}))
#: What may hold names: words with a capital, initials and titles, with single blanks between them.
RUN = re.compile(rf"\b(?=[{_capitals()}{_FIRST}]){_TOKEN}(?: {_TOKEN})+")
#: One capitalised word.
LONE = re.compile(rf"\b{_WORD}")
#: A group's name without its number is the kind; the mention is what the group holds.
PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?i:password|passwd|secret|token|api_?key)[\"']?(?: *= *|: *(?=[\"']?[^\s\"',;0-9]*[0-9]))[\"']?(?P<secret>[^\s\"',;]{6,})"
    r"|(?P<secret2>\bAKIA[0-9A-Z]{16}\b|\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,64}\b)"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b)"
    r"|(?P<phone>\+[0-9](?:[ .()/-]{0,2}[0-9]){7,14}(?![0-9]))"
    r"|(?P<card>\b(?:[0-9][ -]?){12,18}[0-9]\b)"
    r"|(?P<ip>\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b)"
    r"|(?P<ssn>\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b)"
    r"|(?P<phone2>(?:\([0-9]{2,4}\)[ .-]?|\b(?!(?:19|20)[0-9]{2}[ .-](?:19|20)[0-9]{2}\b)[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}\b"
    r"|(?<![\w./-])(?:\(0[0-9]{1,4}\)|0[0-9]{1,4})(?: ?[/-] ?| )[0-9]{4,8}(?:[ -][0-9]{2,4})?(?![\w.-]*[0-9])|(?<![\w./-])0[1-9](?:[ .][0-9]{2}){4}\b)"
)
#: A text without the first has nothing that PATTERN finds, one without the second no names (RE2, decided for whole batches):
#: more texts than have any, never fewer.
MARKS = "[0-9@=:]|AKIA"
NAMES = rf"\p{{Lu}}\S* \p{{Lu}}|(?:^|\PL)(?i:{'|'.join(map(re.escape, TITLES))})\.? \p{{Lu}}"


def _script(text: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", text) else "latin"


@dataclass
class Person:
    """A mention of a person: where it is, its title, the names before the family name, the family name."""

    start: int
    end: int
    title: str
    before: list[str]
    family: str
    strong: bool
    gender: str = "u"

    @property
    def given(self) -> str:
        return _fold(self.before[0]) if self.before else ""

    @property
    def middle(self) -> str:
        return " ".join(_fold(x) for x in self.before[1:])


@dataclass
class Cluster:
    """One person of one text."""

    script: str
    family: str
    gender: str
    given: str
    middle: str
    strong: bool
    mentions: list[Person] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)

    @property
    def entity(self) -> str:
        return f"{self.script}|{self.gender}|{self.given}|{self.middle}|{self.family}"

    def agrees(self, other: Person) -> bool:
        alike = not other.given or _agree(self.given, other.given) and (not self.middle or not other.middle or _agree(self.middle, other.middle))
        return alike and (self.gender == other.gender or "u" in (self.gender, other.gender))

    def before(self, at: int) -> int:
        """Where the last mention before a place starts, or -1."""
        i = bisect.bisect_left(self.starts, at)
        return self.starts[i - 1] if i else -1

    def take(self, other: Person) -> None:
        self.mentions.append(other)
        bisect.insort(self.starts, other.start)
        self.given, self.middle = max(self.given, other.given, key=len), max(self.middle, other.middle, key=len)
        self.gender = other.gender if self.gender == "u" else self.gender
        self.strong |= other.strong


def _fold(name: str) -> str:
    return name.casefold().replace(".", "").replace("|", "")


def _agree(a: str, b: str) -> bool:
    """The same names, or one is the other's initial."""
    return a == b or (bool(a) and bool(b) and min(len(a), len(b)) == 1 and a[0] == b[0])


def _stem(family: str) -> tuple[str, bool]:
    """Folded family name in the form that men bear, and whether it stood in the women's form."""
    name = _fold(family)
    return (name[:-1], True) if re.search("(?:ов|ев|ёв|ин|ын)а$", name) else (name, False)


def _initial(token: str) -> bool:
    return token.endswith(".") or len(token) == 1


def _persons(text: str) -> Iterator[Person]:
    """Mentions of persons: what follows a title, a listed given name with a family name, or names by their shape."""
    for run in RUN.finditer(text):
        tokens, at = [], run.start()
        for token in run[0].split(" "):
            tokens.append((at, token))
            at += len(token) + 1
        titled = [token.rstrip(".").casefold() in TITLES for _, token in tokens]
        listed = [token.casefold() in GENDER for _, token in tokens]
        i, loose = 0, []

        def person(first: int, last: int, title: str, strong: bool) -> Person:
            names = [token for _, token in tokens[first:last]]
            start = tokens[first][0] - (len(title) + 1 if title else 0)
            gender = TITLES.get(title.rstrip(".").casefold(), "u")
            gender = GENDER.get(_fold(names[0]), gender) if gender == "u" and len(names) > 1 else gender
            gender = "f" if gender == "u" and _stem(names[-1])[1] else gender
            return Person(start, tokens[last - 1][0] + len(tokens[last - 1][1]), title, names[:-1], names[-1], strong, gender)

        def by_shape(span: list[int]) -> Iterator[Person]:
            while span and (tokens[span[0]][1].casefold() in STARTERS or len(tokens[span[0]][1]) == 1):
                span = span[1:]
            names = [tokens[j][1] for j in span]
            words = [x for x in names if not _initial(x)]
            mixed = all(x[1:] != x[1:].upper() and x.casefold() not in STARTERS for x in words)
            if 2 <= len(names) <= 3 and mixed and not _initial(names[-1]) and len(set(words)) == len(words):
                yield person(span[0], span[-1] + 1, "", False)

        while i < len(tokens):
            named = titled[i] and i + 1 < len(tokens)
            begin = i + 1 if named else i
            if not (named or listed[i] and i + 1 < len(tokens) and not titled[i + 1]):
                loose.append(i)
                i += 1
                continue
            yield from by_shape(loose)
            loose, last, families = [], begin, 0
            while last < len(tokens) and last - begin < 4 and not titled[last]:
                if families and last > begin + (1 if listed[begin] else 0) and listed[last] and last + 1 < len(tokens):
                    break  # the next person's given name
                families += not _initial(tokens[last][1]) and not (last == begin and listed[last])
                last += 1
            while last > begin and _initial(tokens[last - 1][1]):
                last -= 1
            if last > begin + (0 if named else 1):
                yield person(begin, last, tokens[i][1] if named else "", True)
                i = last
            else:
                i += 1
        yield from by_shape(loose)


def _clusters(persons: list[Person]) -> list[Cluster]:
    """Fuller names first; initials and titles with a family name then join the person they agree with.

    Of several, the one mentioned last before it. A family name alone with a title that agrees with none is a person.
    """
    of_family: dict[tuple[str, str], list[Cluster]] = {}

    def rank(x: Person) -> tuple[int, int]:
        return (0 if len(x.given) > 1 else 1 if x.given else 2, x.start)

    for x in sorted(persons, key=rank):
        key = (_script(x.family), _stem(x.family)[0])
        known = [c for c in of_family.setdefault(key, []) if c.agrees(x)]
        if known:
            max(known, key=lambda c: c.before(x.start)).take(x)
        else:
            of_family[key].append(Cluster(*key, x.gender, x.given, x.middle, x.strong, [x], [x.start]))
    return [c for group in of_family.values() for c in group]


def _lone(text: str, clusters: list[Cluster], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, Cluster]]:
    """Given and family names that stand alone, of persons told by a title or a listed name."""
    named: dict[str, list[tuple[str, Cluster]]] = {}
    for c in clusters:
        told = {(role, t) for m in c.mentions for role, t in [*(("given", t) for t in m.before[:1]), ("family", m.family)]} if c.strong else ()
        for role, token in sorted(told):
            if not _initial(token):
                named.setdefault(token, []).append((role, c))
    if not named:
        return
    free, i = sorted(taken), 0
    for m in LONE.finditer(text):
        owners = named.get(m[0])
        while i < len(free) and free[i][1] <= m.start():
            i += 1
        if owners and (i == len(free) or free[i][0] >= m.end()):
            role, c = max(owners, key=lambda x: x[1].before(m.start()))
            if c.before(m.start()) >= 0:  # once introduced
                yield m.start(), m.end(), role, c


def canonical(kind: str, mention: str) -> str:
    """What mentions of one entity have in common (persons: see `found`)."""
    if kind == "email":
        return mention.lower()
    if kind in ("card", "phone", "ssn"):
        return re.sub(r"\D", "", mention)
    if kind == "iban":
        return mention.replace(" ", "").upper()
    return mention


class Draw:
    """Endless keyed numbers of one entity and attempt."""

    def __init__(self, key: bytes, *parts: object):
        self.seed = hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()
        self.block, self.left = 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest()
            self.block += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x * n >> 32

    def like(self, text: str, signs: bool = False) -> str:
        """Digits for digits, letters for letters of the same case, hexadecimal where all of it is.

        Other scripts become ASCII letters. Signs stay, unless `signs` says otherwise or there is nothing else.
        """
        hexa = re.fullmatch("[0-9a-f]{32,}", text)
        signs = signs or not re.search("[0-9A-Za-z\x80-\U0010ffff]", text)
        out = []
        for ch in text:
            if hexa:
                out.append("0123456789abcdef"[self.below(16)])
            elif "0" <= ch <= "9":
                out.append(str(self.below(10)))
            elif "a" <= ch <= "z":
                out.append(chr(97 + self.below(26)))
            elif "A" <= ch <= "Z":
                out.append(chr(65 + self.below(26)))
            elif signs or not ch.isascii():
                out.append(chr((65 if ch.isupper() else 97) + self.below(26)))
            else:
                out.append(ch)
        return "".join(out)


def _luhn(digits: str) -> int:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        x = int(ch) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """Canonical form of the replacement.

    What can be drawn grows with the attempt, so that some attempt is free however many entities look alike.
    """
    draw = Draw(key, kind, entity, attempt)
    longer = "0" * (attempt // WIDEN)
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels = domain.split(".")
        # One domain keeps one surrogate, so addresses at one place stay at one place; the top label stays.
        # Only addresses that found no free local part there move on to another.
        late = [attempt] if attempt >= MOVE else []
        other = ".".join([*(Draw(key, "domain", domain, i, *late).like(x) for i, x in enumerate(labels[:-1])), labels[-1]])
        return f"{draw.like(local + longer)}@{other}"
    if kind == "card":
        body = entity[0] + draw.like(entity[1:-1] + longer)  # the first digit tells the network
        check = (10 - _luhn(body + "0")) % 10
        return f"{body}{check}" if _luhn(entity) == 0 else f"{body}{(check + 1 + draw.below(9)) % 10}"
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "phone":
        # What a plus sign announces (the country) can't be told from digits alone; the first digit stays.
        return entity[0] + draw.like(entity[1:] + longer)
    if kind == "iban":
        body = draw.like(entity[4:] + longer)
        value = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00"))
        return f"{entity[:2]}{98 - value % 97:02d}{body}"
    if kind == "secret" and re.fullmatch("AKIA[0-9A-Z]{16}", entity):
        return "AKIA" + draw.like(entity[4:])
    if kind == "secret":
        return draw.like(entity, attempt >= MOVE) + draw.like(longer)
    if kind == "person":
        script, gender, given, middle, family = entity.split("|")
        of = gender if gender != "u" else "fm"[draw.below(2)]
        names, families = GIVEN[script, of], FAMILY[script]

        def like(name: str) -> str:
            new = names[draw.below(len(names))].casefold()
            return new[0] if len(name) == 1 else new

        first = like(given) if given else ""
        between = " ".join(like(x) for x in middle.split())
        last = families[draw.below(len(families))].casefold()
        # Where the lists are exhausted, a second family name keeps entities distinct.
        for _ in longer:
            last += "-" + families[draw.below(len(families))].casefold()
        return f"{script}|{gender}|{first}|{between}|{last}"
    return draw.like(entity + longer)


def render(kind: str, mention: str, replacement: str) -> str:
    """The canonical replacement in the format of the mention."""
    if kind == "email":
        local, _, domain = mention.partition("@")
        new_local, _, new_domain = replacement.partition("@")
        parts = ((local, new_local), (domain, new_domain))
        return "@".join("".join(n.upper() if o.isupper() else n for o, n in zip_longest(old, new, fillvalue="")) for old, new in parts)
    if kind in ("card", "phone", "ssn", "iban"):
        source = iter(replacement)
        return "".join([*(next(source) if ch.isalnum() else ch for ch in mention), *source])
    if kind in ("person", "given", "family"):
        script, gender, new_given, new_middle, new_family = replacement.split("|")
        new_family += "а" if script == "cyrillic" and gender == "f" else ""

        def cased(old: str, new: str) -> str:
            if _initial(old):
                return "-".join(f"{new[:1].upper()}." for _ in old.split("-")) if old.endswith(".") else new[:1].upper()
            return new.upper() if len(old) > 1 and old.isupper() else "-".join(x.capitalize() for x in new.split("-"))

        if kind != "person":
            return cased(mention, new_given if kind == "given" else new_family)
        *before, family = mention.split(" ")
        title = [before.pop(0)] if before and before[0].rstrip(".").casefold() in TITLES else []
        drawn = [new_given, *new_middle.split()]
        # A middle name that only other mentions have is left out; one beyond them is the last one's initial again.
        names = [cased(old, drawn[min(i, len(drawn) - 1)]) for i, old in enumerate(before)]
        return " ".join([*title, *names, cased(family, new_family)])
    return replacement


def found(text: str, marks: bool = True, names: bool = True) -> list[tuple[int, int, str, str, str, bool]]:
    """Mentions in order: start, end, form to write, kind, entity, and whether shape alone tells it."""
    out = []
    for m in PATTERN.finditer(text) if marks else ():
        kind = m.lastgroup.rstrip("2")
        a, b = m.span(m.lastgroup)
        out.append((a, b, kind, kind, canonical(kind, text[a:b]), False))
    spans, i, persons = [x[:2] for x in out], 0, []
    for x in _persons(text) if names else ():
        while i < len(spans) and spans[i][1] <= x.start:
            i += 1
        if i == len(spans) or spans[i][0] >= x.end:
            persons.append(x)
    clusters = _clusters(persons)
    out += [(m.start, m.end, "person", "person", c.entity, not c.strong) for c in clusters for m in c.mentions]
    if clusters:
        out += [(a, b, role, "person", c.entity, False) for a, b, role, c in _lone(text, clusters, [x[:2] for x in out])]
    return sorted(out)


def mentions(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and kind of each mention, names by shape included."""
    for a, b, _, kind, _, _ in found(text):
        yield a, b, kind


def _hinted(column: pa.Array) -> Iterator[tuple[bool, bool]]:
    """Of each text, whether it may have marks and whether it may have names."""
    marks, names = (pc.fill_null(pc.match_substring_regex(column, hint), False).to_pylist() for hint in (MARKS, NAMES))
    return zip(marks, names, strict=True)


def _all_found(column: pa.Array) -> Iterator[list[tuple[int, int, str, str, str, bool]]]:
    """What is found in each text of a batch."""
    for text, (marks, names) in zip(column.to_pylist(), _hinted(column), strict=True):
        yield found(text, marks, names) if marks or names else []


def entities(docs: DataFrame) -> DataFrame:
    """(kind, entity, weak) of all texts, pre-aggregated per task; weak: nothing but shape tells it anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in common.text_chunks(batches):
            column, weak = chunk.column("text"), {}
            for of_text in _all_found(column):
                for _, _, _, kind, entity, loose in of_text:
                    weak[kind, entity] = weak.get((kind, entity), True) and loose
            rows = [(k, e, w) for (k, e), w in sorted(weak.items())]
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            types = (pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "entity", "weak"])

    return docs.select("text").mapInArrow(run, "kind string, entity string, weak boolean").groupBy("kind", "entity").agg(F.bool_and("weak").alias("weak"))


def ordinary(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, entity) of names told by shape alone of which some word is written in lower case in some text."""
    names = F.split(F.array_join(F.slice(F.split("entity", "[|]"), 3, 3), " "), r"[^\p{L}]+")
    asked = known.where("weak").select("kind", "entity", F.explode(names).alias("word")).where("length(word) > 1")
    asked = common.materialise(asked)
    wanted = asked.select("word").distinct()
    written = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<!\p{L})(\p{Ll}\p{L}+)"), 1)))
    words = docs.select(written.alias("word")).select(F.lower("word").alias("word"))
    seen = common.keep_ids(words, wanted, "word").distinct()
    return asked.join(seen, "word").select("kind", "entity").distinct()


def _unsexed(kind: str, entity: str) -> str:
    """What is written of an entity: a person's name without the gender."""
    return re.sub(r"^(\w+)\|[fmu]\|", r"\1||", entity) if kind == "person" else entity


def exceptions(known: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt) of entities whose first draw collides, with the attempt that doesn't.

    A draw is good if no other entity holds it, no entity of the corpus looks like it, and it isn't the entity
    itself. Of entities that draw the same, the least keeps it. Each round only redraws what collided.
    """

    def drawn(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "entity", "attempt")), strict=True)
                new = [_unsexed(k, surrogate(key, k, e, a)) for k, e, a in rows]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "entity", "attempt", "drawn"])

        return rows.select("kind", "entity", "attempt").mapInArrow(run, "kind string, entity string, attempt int, drawn string")

    unsexed = F.regexp_replace("entity", r"^(\w+)\|[fmu]\|", "$1||")
    taken = known.select("kind", F.when(F.col("kind") == "person", unsexed).otherwise(F.col("entity")).alias("drawn")).distinct()
    held = common.materialise(drawn(known.withColumn("attempt", F.lit(0))))
    while True:
        clash = held.join(taken, ["kind", "drawn"], "left_semi").select("kind", "entity", "attempt")
        least = held.groupBy("kind", "drawn").agg(F.min(F.struct("attempt", "entity")).alias("first"), F.count("*").alias("many")).where("many > 1")
        twins = held.join(least, ["kind", "drawn"]).where(F.struct("attempt", "entity") != F.col("first")).select("kind", "entity", "attempt")
        again = common.materialise(clash.union(twins).distinct())
        if again.isEmpty():
            return held.where("attempt > 0").select("kind", "entity", "attempt")
        redrawn = drawn(again.withColumn("attempt", F.col("attempt") + 1))
        held = common.materialise(held.join(again.select("kind", "entity"), ["kind", "entity"], "left_anti").select(*redrawn.columns).union(redrawn))


def _free(columns: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that no column has, in any case of letters."""
    longest = max(map(len, columns), default=0)
    return [f"{x}_{'x' * longest}" for x in wanted]


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """All rows and columns of docs with every entity in text replaced, and n_entities (mentions replaced).

    Null text stays null with 0 entities; a text without entities stays as it is. Repeated rows get equal
    results. A column n_entities of docs is replaced; other columns may bear any name.
    """
    rows = docs.drop("n_entities")
    odd_name, tie = _free(rows.columns, "odd", "tie")
    known = common.materialise(entities(rows))
    plain = common.materialise(ordinary(rows, known))
    kept = known.join(plain, ["kind", "entity"], "left_anti").select("kind", "entity")
    odd = common.materialise(exceptions(common.materialise(kept), key).union(plain.withColumn("attempt", F.lit(LEAVE))))
    names = rows.columns
    shape = rows.select(*names, F.lit(0).alias("n_entities")).schema
    columns = shape.names

    def rewritten(with_odd: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache: dict[tuple[str, str, int], str] = {}
            for chunk in common.text_chunks(batches):
                column = chunk.column("text")
                texts, counts = column.to_pylist(), [0] * chunk.num_rows
                attempts = chunk.column(odd_name).to_pylist() if odd_name in chunk.schema.names else [None] * chunk.num_rows
                for i, of_text in enumerate(_all_found(column)):
                    if not of_text:
                        continue
                    own = {(x["kind"], x["entity"]): x["attempt"] for x in attempts[i] or []}
                    out, at = [], 0
                    for a, b, form, kind, entity, _ in of_text:
                        wanted = (kind, entity, own.get((kind, entity), 0))
                        if wanted[2] == LEAVE:
                            continue
                        if wanted not in cache:
                            if len(cache) > 100_000:
                                cache.clear()
                            cache[wanted] = surrogate(key, *wanted)
                        out += [texts[i][at:a], render(form, texts[i][a:b], cache[wanted])]
                        at, counts[i] = b, counts[i] + 1
                    texts[i] = "".join([*out, texts[i][at:]])
                new = {"text": pa.array(texts, pa.string()), "n_entities": pa.array(counts, pa.int32())}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else chunk.column(c) for c in columns], names=columns)

        return with_odd.mapInArrow(run, shape)

    if odd.isEmpty():
        return rewritten(rows)

    def mentioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in common.text_chunks(batches):
            column = chunk.column("text")
            ties, pairs = chunk.column(tie).to_pylist(), set()
            for of_tie, of_text in zip(ties, _all_found(column), strict=True):
                pairs |= {(of_tie, kind, entity) for _, _, _, kind, entity, _ in of_text}
            cols = list(zip(*sorted(pairs), strict=True)) if pairs else [(), (), ()]
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[tie, "kind", "entity"])

    # Exceptions go to the texts (by text hash) that mention them, then beside each text.
    tied = rows.withColumn(tie, F.xxhash64("text"))
    pairs = tied.select(tie, "text").mapInArrow(mentioned, f"{tie} bigint, kind string, entity string").distinct()
    per_text = pairs.join(odd, ["kind", "entity"]).groupBy(tie).agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias(odd_name))
    per_text = common.materialise(per_text)
    small = per_text.count() <= common.BROADCAST_IDS // 8
    return rewritten(tied.join(F.broadcast(per_text) if small else per_text.hint("merge"), tie, "left").drop(tie))
