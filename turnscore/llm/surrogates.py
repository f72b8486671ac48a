"""Replacement of personal data by surrogates of the same kind and form.

A surrogate is a keyed permutation of its entity within the entity's form: letters stay
letters of the same script and case (vowels stay vowels in names), digits stay digits,
everything else stays in place; valid card numbers stay valid, address octets stay
octets, and known given names are permuted among names of their gender and script, while
other name parts keep their last letter, which may mark gender. So entities of one form
never meet. A surrogate that is itself an entity of the corpus, or that another entity
took, is drawn again with another key; these collision checks are joins over all
distinct entities, and every mention of an entity gets the one surrogate."""

from __future__ import annotations

import hashlib
import hmac
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore.llm import kernels
from turnscore.llm.common import hash_bitmap, materialize, ship, text_or_empty

#: Rounds of drawing; later ones lengthen the form, so that even a small form has room.
ROUNDS, LONGER_AFTER = 24, 8
BITS = 1 << 23

LOWER_ACCENTED = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
UPPER_ACCENTED = "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
GREEK = ("αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
CYRILLIC = ("".join(chr(c) for c in range(0x430, 0x450)), "".join(chr(c) for c in range(0x410, 0x430)))
DIGITS, HEX = "0123456789", "0123456789abcdef"
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿαεηιουωаеиоуыэюя"
ALPHABETS = [DIGITS, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", LOWER_ACCENTED, UPPER_ACCENTED, *GREEK, *CYRILLIC]
#: Given names by gender and script.
GIVEN = {
    ("f", "latin"): "Alice Anna Carla Clara Elena Emma Eva Greta Hanna Ida Julia Laura Lea Lucia Maria Marta Nora Olivia Paula Sara Sofia".split(),
    ("m", "latin"): "Adam Albert Bruno Carlos David Emil Felix Georg Henri Hugo Ivan James John Karl Leon Lucas Marco Oscar Paul Peter Robert Simon Thomas".split(),
    ("f", "cyrillic"): "Анна Вера Елена Ирина Мария Нина Ольга Светлана Татьяна".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Иван Николай Олег Павел Пётр Сергей".split(),
    ("f", "greek"): "Αννα Ελενη Ιωαννα Κατερινα Μαρια Σοφια".split(),
    ("m", "greek"): "Αλεξης Γιωργος Δημητρης Κωστας Νικος Πετρος".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sra Sr Г-н Г-жа Κος Κα".split()

_NAME = r"[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫА-ЯЁ](?:[^\W\d_]|['’-](?=[^\W\d_]))*"
PATTERNS = {
    "email": re.compile(r"[^\s@<>()\[\]{}|,;:\"'«»=]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    "secret": re.compile(r"(?i:(?<![a-z])(?:token|secret|passwd|password|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?)([0-9A-Za-z_+/\-]{12,}={0,2})"
                         r"|(?<![0-9A-Za-z])((?:AKIA|ghp_|sk-)[0-9A-Za-z]{16,}|[0-9a-f]{32,})(?![0-9A-Za-z])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    "ip": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"),
    "card": re.compile(r"(?<![\d.])(?:\d{4}[ -]){3}\d{1,7}(?!\d)|(?<![\d.])\d{13,19}(?!\d)"),
    "phone": re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w)"
                        r"|(?<![\w.])\+\d{8,15}(?!\w)"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "person": re.compile(r"(?<!\w)(?:%s)\.? +(%s(?: %s){0,2})" % ("|".join(TITLES), _NAME, _NAME)
                         + r"|(?<!\w)((?:%s) %s)" % ("|".join(n for g in GIVEN.values() for n in g), _NAME)),
}
#: Text without any of these has no entity of the kind; saves most searches.
NEEDS = {"email": re.compile("@"), "secret": re.compile(r"(?i)token|secret|passw|key|AKIA|ghp_|sk-|[0-9a-f]{32}"),
         **{k: re.compile(r"\d\D{0,2}\d") for k in ("iban", "ip", "card", "phone", "ssn")},
         "person": re.compile("|".join(map(re.escape, [*TITLES, *(n for g in GIVEN.values() for n in g)])))}


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), ascending and apart; of overlapping ones the earlier kind of PATTERNS stays."""
    found: list[tuple[int, int, str]] = []
    for kind, pattern in PATTERNS.items():
        if NEEDS[kind].search(text):
            for m in pattern.finditer(text):
                a, b = m.span(m.lastindex or 0)
                if kind == "email":
                    a += len(m[0]) - len(m[0].lstrip("."))
                if b > a and all(b <= x or a >= y for x, y, _ in found):
                    found.append((a, b, kind))
    return sorted(found)


class Surrogates:
    """Keyed permutations within a form. ``draw`` numbers independent ones."""

    def __init__(self, key: bytes):
        self.key = key

    def number(self, *parts) -> int:
        return int.from_bytes(hmac.new(self.key, "\x00".join(map(str, parts)).encode(), hashlib.sha256).digest()[:16], "big")

    def permute(self, values: list[int], sizes: list[int], tweak: str) -> list[int]:
        """A permutation of all digit rows below ``sizes``: an alternating Feistel network of ten rounds."""
        if len(values) == 1:
            order = sorted(range(sizes[0]), key=lambda i: self.number(tweak, sizes[0], i))
            return [order[values[0]]]
        half = len(values) // 2

        def pack(v, s):
            x = 0
            for a, b in zip(v, s):
                x = x * b + a
            return x

        def unpack(x, s):
            out = []
            for b in reversed(s):
                out.append(x % b)
                x //= b
            return out[::-1]

        sl, sr = sizes[:half], sizes[half:]
        nl, nr = int(np.prod(sl, dtype=object)), int(np.prod(sr, dtype=object))
        left, right = pack(values[:half], sl), pack(values[half:], sr)
        for r in range(10):
            if r % 2:
                right = (right + self.number(tweak, r, nl, nr, left)) % nr
            else:
                left = (left + self.number(tweak, r, nl, nr, right)) % nl
        return unpack(left, sl) + unpack(right, sr)

    def letters(self, text: str, tweak: str, alphabets: list[str] = ALPHABETS) -> str:
        at, values, sizes, of = [], [], [], []
        for i, c in enumerate(text):
            for a in alphabets:
                if c in a:
                    at.append(i), values.append(a.index(c)), sizes.append(len(a)), of.append(a)
                    break
        if not at:
            return text
        out = list(text)
        for i, v, a in zip(at, self.permute(values, sizes, tweak + ":" + ",".join(map(str, sizes))), of):
            out[i] = a[v]
        return "".join(out)

    def digits(self, text: str, tweak: str) -> str:
        return self.letters(text, tweak, [DIGITS])

    def card(self, text: str, tweak: str) -> str:
        """The last digit keeps its distance from the Luhn check digit."""
        def check(d: str) -> int:
            total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(d)))
            return -total % 10

        plain = [i for i, c in enumerate(text) if c.isdigit()]
        old = "".join(text[i] for i in plain)
        new = self.digits(old[:-1], tweak)
        new += str((check(new) + int(old[-1]) - check(old[:-1])) % 10)
        out = list(text)
        for i, c in zip(plain, new):
            out[i] = c
        return "".join(out)

    def ip(self, text: str, tweak: str) -> str:
        return ".".join(map(str, self.permute([int(x) for x in text.split(".")], [256] * 4, tweak)))

    def email(self, text: str, tweak: str) -> str:
        local, _, domain = text.rpartition("@")
        host, _, top = domain.rpartition(".")
        return self.letters(local, tweak) + "@" + self.letters(host, tweak + "@") + "." + top

    def secret(self, text: str, tweak: str) -> str:
        if re.fullmatch("[0-9a-f]+", text):
            return self.letters(text, tweak, [HEX])
        head = re.match("AKIA|ghp_|sk-|", text)[0]
        return head + self.letters(text[len(head):], tweak)

    def phone(self, text: str, tweak: str) -> str:
        country = re.match(r"\+\d{1,3}(?=[ .(-])|", text)[0]
        return country + self.digits(text[len(country):], tweak)

    def iban(self, text: str, tweak: str) -> str:
        return text[:2] + self.letters(text[2:], tweak)

    def person(self, text: str, tweak: str) -> str:
        out = []
        for part in text.split(" "):
            pool = next((p for p in GIVEN.values() if part in p), None)
            if pool:
                order = sorted(range(len(pool)), key=lambda i: self.number(tweak, "given", i))
                out.append(pool[order[pool.index(part)]])
                continue
            kinds = [x for a in ALPHABETS[1:] for x in ("".join(c for c in a if c.lower() in VOWELS), "".join(c for c in a if c.lower() not in VOWELS))]
            new = part
            for _ in range(64):  # not into the given names: the walk stays a permutation of the others
                new = self.letters(new[:-1], tweak, kinds) + new[-1:]
                if not any(new in p for p in GIVEN.values()):
                    break
            out.append(new)
        return " ".join(out)

    def __call__(self, kind: str, text: str, draw: int = 0) -> str:
        tweak = f"{kind}:{draw}"
        make = getattr(self, kind, None)
        new = make(text, tweak) if make else self.letters(text, tweak)
        if draw >= LONGER_AFTER:
            more = str(self.number(tweak, text) % 10 ** (draw - LONGER_AFTER + 4))
            if kind == "email":
                local, _, domain = new.rpartition("@")
                return local + more + "@" + domain
            if kind == "person":
                return new + " " + self.letters("Abena", tweak + text, [ALPHABETS[1], ALPHABETS[2]])
            return new + more if kind != "ip" else self.ip(new, tweak + "x")
        return new


def surrogate_table(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate), one to one within a kind and never a value of ``entities`` (distinct kind, value)."""
    make = Surrogates(key)
    entities = materialize(entities, "entities")

    def drawing(draw):
        def run(batches):
            for b in batches:
                new = [make(k, v, draw) for k, v in zip(b.column("kind").to_pylist(), b.column("value").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("value"), pa.array(new, pa.string())], ["kind", "value", "surrogate"])
        return run

    open_, taken = entities, None
    real = entities.select("kind", F.col("value").alias("surrogate"))
    for draw in range(ROUNDS):
        drawn = open_.mapInArrow(kernels.tidy(drawing(draw)), "kind string, value string, surrogate string").join(real, ["kind", "surrogate"], "left_anti")
        if taken is not None:
            drawn = drawn.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        drawn = materialize(drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate"), "drawn")
        taken = drawn if taken is None else taken.unionByName(drawn)
        open_ = materialize(open_.join(drawn, ["kind", "value"], "left_anti"), "open")
        if open_.isEmpty():
            return taken
    raise RuntimeError("some entities found no surrogate: their form has too few values")


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text with surrogates, n_entities (mentions), n_distinct.

    Null text stays null and counts no entities; texts without entities stay as they are.
    An entity is its kind and exact spelling; all its mentions, in all documents, get the
    same surrogate, and different entities get different ones. Repeated rows and null ids
    are kept and changed alike. An empty table gives no rows. Other columns are not read."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64(text_or_empty("text")))
    kind = own.schema["id"].dataType.simpleString()

    def mentions(batches):
        for b in batches:
            row, kinds, values = [], [], []
            for i, t in enumerate(b.column("text")):
                t = t.as_py() or ""
                for k, v in sorted({(k, t[x:y]) for x, y, k in find_entities(t)}):
                    row.append(i), kinds.append(k), values.append(v)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row, pa.int64())), b.column("th").take(pa.array(row, pa.int64())),
                                              pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["id", "th", "kind", "value"])

    found = materialize(own.mapInArrow(kernels.tidy(mentions), f"id {kind}, th long, kind string, value string"), "mentions")
    table = surrogate_table(found.select("kind", "value").distinct(), key)
    changes = materialize(found.join(table, ["kind", "value"]).groupBy("id", "th")
                          .agg(F.collect_set(F.struct("kind", "value", "surrogate")).alias("changes")), "changes")
    likely = own.sparkSession.sparkContext.broadcast(hash_bitmap(changes, "th", BITS))

    def some(wanted):
        def run(batches):
            bits = likely.value
            for b in batches:
                th = b.column("th").to_numpy() % BITS
                yield b.filter(pa.array((bits[th >> 3] >> (th & 7) & 1) == wanted))
        return run

    def rewrite(batches):
        for b in batches:
            out, n, distinct = [], [], []
            for t, c in zip(b.column("text"), b.column("changes")):
                t, new = t.as_py(), {(x["kind"], x["value"]): x["surrogate"] for x in c.as_py() or ()}
                at = [e for e in find_entities(t or "") if new]
                pieces, last = [], 0
                for x, y, k in at:
                    pieces += [t[last:x], new[k, t[x:y]]]
                    last = y
                out.append(t if not at else "".join(pieces) + t[last:]), n.append(len(at)), distinct.append(len(new))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(distinct, pa.int64())],
                                             ["id", "text", "n_entities", "n_distinct"])

    changes = changes.withColumnRenamed("id", "rid").withColumnRenamed("th", "rth")
    changed = (own.mapInArrow(kernels.tidy(some(1)), own.schema).join(changes, (F.col("th") == F.col("rth")) & F.col("id").eqNullSafe(F.col("rid")), "left")
               .select("id", "text", "changes").mapInArrow(kernels.tidy(rewrite), f"id {kind}, text string, n_entities long, n_distinct long"))
    zero = F.lit(0).cast("long")
    same = own.mapInArrow(kernels.tidy(some(0)), own.schema).select("id", "text", zero.alias("n_entities"), zero.alias("n_distinct"))
    return changed.unionByName(same).withColumnRenamed("id", id_col)


ship(__name__)
