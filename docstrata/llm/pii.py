r"""Personal data and secrets: fixed base patterns, and proposals chosen by boosted trees. No Python on executors.

Base kinds (email, ip, card, phone) are found by their patterns alone and always stay. Five generous
generators propose further spans, which may overlap each other and the base: keyword assignments, long
mixed tokens, account numbers, grouped digits without a plus sign, and spelt-out addresses. Trees score
each proposal from its format and the words before it; a proposal is selected if its score reaches its
kind's threshold. The trees learn from one family of made-up sentences; the thresholds are set on another family
with other words, names and forms, so that the precision they promise is not that of the sentences learnt from.
A selected proposal inside a base span goes; of two that overlap, the one that holds the other stays, else the one with the higher score, else the first.

Positions come from marking the matches of a pattern with a control character and adding up the
lengths of the parts (in code points). Where a text holds that character itself, it is first
exchanged for another one that no pattern knows, so no position moves. Every running total over a text's
matches is taken in blocks (``_scan``), and no pattern gives back what a repeated group has taken, so the time
and the stack of a long text grow with its length only.

Defined results: a null text counts as empty and has no spans; repeated rows and ids are judged alike, each for
itself; texts of any length are read whole; an empty table gives an empty one; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.boosting import Boosted

# A match starts where its run of characters starts or where the last match ended: the same matches
# as without this guard, and no second look at each character of a long run. Repeated groups are
# possessive: what follows them can never need what they have taken.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Words of the four languages that come before a secret.
_WORDS = "pass(?:word|wd|wort|phrase|code)|pwd|kennwort|mot de passe|contrase(?:ñ|n)a|clave|secret|geheimnis|token|jeton|api[_-]?key|access[_-]?key|private[_-]?key|credential"
PROPOSED = {
    "secret": rf"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?i:{_WORDS}))[A-Za-z0-9_-]*+[\"']? ?(?:[=:]|(?:is|ist|lautet|est|es)(?= )) ?[\"']?[^\s\"']{{6,}}+[\"']?",
    "key": r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++){1,2}|(?<![A-Za-z0-9_])[Bb]earer [A-Za-z0-9._~+/=-]{16,}+|(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{16,}+",
    "account": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    # grouped digits, trunk zeros, pairs and threes, national numbers with a check letter
    "number": r"(?<![0-9A-Za-z+.])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|\(?0[1-9][0-9]{0,3}\)?[ /.-][0-9]{2,8}(?:[ .-][0-9]{2,4}){0,4}+|[0-9]{2,3}(?: [0-9]{2,3}){3,4}|(?:[0-9]{8}|[XYZ][0-9]{7})-?[A-Z])(?![0-9A-Za-z])",
    "spelt": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?+(?:\[at\]|\(at\)) ?+[A-Za-z0-9-]++(?: ?+(?:\[dot\]|\(dot\)|\.) ?+[A-Za-z]{2,}+)++|(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ (?:(?:at|AT) [A-Za-z0-9-]++(?: (?:dot|DOT) [A-Za-z0-9-]++)*? (?:dot|DOT)|(?:arobase|arroba|at) [A-Za-z0-9-]++(?: (?:point|punto|punkt) [A-Za-z0-9-]++)*? (?:point|punto|punkt)) (?:com|org|net|edu|gov|info|eu|uk|de|fr|es|ch|at|it|nl|be|mx)(?![A-Za-z0-9])",
}
KINDS = [*BASE, *PROPOSED]
FEATURES = ["size", "digits", "upper", "lower", "runs", "marks", "hex", "keyed", "prefixed", "person", "counted", "mixed"]
# Words that speak for or against a proposal, in the 24 characters before it or in itself.
KEYED = rf"(?i){_WORDS}"
PREFIXED = r"^(?:AKIA|ASIA|ghp_|gho_|xox|sk_|pk_|eyJ|[Bb]earer )"
PERSON = r"(?i)ssn|social|phone|tel|t[éÉ]l|call|mobil|m[óÓ]vil|handy|portable|fax|iban|account|konto|compte|cuenta|passport|ausweis|tax|steuer|nif|dni|s[éÉ]cu|ruf|llam|appele"
COUNTED = r"(?i)order|invoice|isbn|issue|version|page|part|serial|build|commit|sha|bestell|rechnung|seite|commande|facture|pedido|factura|version"
# Letters and digits in what follows the last blank, colon or equals sign of an assignment.
LAST, MIXED = r"^.*[=: ]", r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])"
CONTEXT = 24
TREES = 40


def _features(kind: str, before: str, value: str) -> list[float]:
    """The features of a proposal; ``_feature_sql`` says the same."""
    runs = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", value))
    has = lambda p, s: float(bool(re.search(p, s)))
    count = lambda p: float(len(re.findall(p, value)))
    return [float(len(value)), count("[0-9]"), count("[A-Z]"), count("[a-z]"), float(len(runs)), count("[^A-Za-z0-9]"), has(r"^[0-9a-f]+$", value), has(KEYED, before + value), has(PREFIXED, value), has(PERSON, before), has(COUNTED, before), has(KEYED, value) * has(MIXED, re.sub(LAST, "", value))]


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feature_sql(c: str) -> str:
    count = lambda p: f"(length({c}.v) - length(regexp_replace({c}.v, '{p}', '')))"
    has = lambda p, s: f"IF({s} RLIKE {_quoted(p)}, 1, 0)"
    runs = f"length(regexp_replace(regexp_replace({c}.v, '[0-9]+', '9'), '[A-Za-z]+', 'a'))"
    values = [f"length({c}.v)", count("[0-9]"), count("[A-Z]"), count("[a-z]"), runs, count("[^A-Za-z0-9]"), has(r"^[0-9a-f]+$", f"{c}.v"), has(KEYED, f"concat({c}.b, {c}.v)"), has(PREFIXED, f"{c}.v"), has(PERSON, f"{c}.b"), has(COUNTED, f"{c}.b"), f"{has(KEYED, f'{c}.v')} * " + has(MIXED, f"regexp_replace({c}.v, {_quoted(LAST)}, '')")]
    return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(FEATURES, values)) + ")"


LOW, UP, DIG, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


# What stands between a quoted name and its value.
QUOTED = ['": "', "': '", '" : "']


def _pick(r: random.Random, chars: str, k: int) -> str:
    return "".join(r.choice(chars) for _ in range(k))


def _learnt(r: random.Random) -> list[tuple[str, str, int, str]]:
    """One round of made-up proposals to learn from: kind, value, private or not, the word before it."""
    pick = lambda chars, k: _pick(r, chars, k)
    person = ["ssn", "phone:", "tel", "call", "mobile", "iban", "account", "fax", "tax id"]
    count = ["order", "invoice", "isbn", "version", "page", "part", "serial", "build", "commit"]
    grouped = r.choice([f"{pick(DIG, 3)}-{pick(DIG, 2)}-{pick(DIG, 4)}", f"{pick(DIG, 3)}-{pick(DIG, 3)}-{pick(DIG, 4)}", f"({pick(DIG, 3)}) {pick(DIG, 3)}-{pick(DIG, 4)}"])
    name, quote = r.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "Password"]), r.choice(['"', "'", ""])
    other = r.choice([f"0{r.randint(1, 9)}{pick(DIG, 1)} {pick(DIG, r.randint(5, 8))}", f"0{r.randint(1, 9)} " + " ".join(pick(DIG, 2) for _ in range(4)), f"9{r.randint(1, 9)} {pick(DIG, 3)} {pick(DIG, 2)} {pick(DIG, 2)}", f"(0{r.randint(10, 99)}) {pick(DIG, 4)}-{pick(DIG, 3)}", f"0{r.randint(100, 999)}/{pick(DIG, 6)}"])
    value = r.choice([pick(HEX, r.randint(8, 40)), pick(LOW + UP + DIG, r.randint(8, 24)) + pick(DIG, 2), pick(LOW + UP, r.randint(8, 16)) + r.choice("_-!#$") + pick(LOW, 2), r.choice([pick(LOW, 6), pick(LOW, 6).title()]) + pick(DIG, r.randint(2, 4)) + r.choice(["", "!", "#", "$"])])
    return [
        ("number", grouped, 1, r.choice(person)),
        ("number", grouped, 0, r.choice([*count, "", ""])),
        ("secret", f"{name}{r.choice(['=', ' = ', ': '])}{quote}{value}{quote}", 1, ""),
        ("secret", f"{name}: {pick(LOW, r.randint(6, 12))}", 0, ""),
        ("secret", f"{r.choice(['password', 'Passwort', 'clave', 'mot de passe', 'contraseña', 'AWS_SECRET_ACCESS_KEY', 'db_password'])}{r.choice([' is ', ' ist ', ' : ', '=', r.choice(QUOTED)])}{value}", 1, r.choice(["my", "das", "le", ""])),
        ("secret", f"{r.choice(['password', 'Passwort', 'clave', 'contraseña', 'secret', 'token', 'mot de passe'])}{r.choice([' is ', ' ist ', ' es ', ' est ', ': '])}{pick(LOW, r.randint(6, 14))}{r.choice(['', '.', ','])}", 0, r.choice(["the", "das", "la", ""])),
        ("key", f"eyJ{pick(LOW + UP + DIG, r.randint(17, 40))}.eyJ{pick(LOW + UP + DIG, r.randint(20, 60))}{r.choice(['', '.' + pick(LOW + UP + DIG + '_-', 43)])}", 1, ""),
        ("key", f"{r.choice(['Bearer', 'bearer'])} {r.choice([pick(LOW + UP + DIG, r.randint(20, 60)), pick(HEX, 40)])}", 1, "Authorization:"),
        ("key", f"{r.choice(['Bearer', 'bearer'])} {pick(LOW, r.randint(16, 22))}", 0, r.choice(["the", ""])),
        ("number", other, 1, r.choice(["Tel.", "tél", "telefon", "Telefon:", "móvil", "Handy", "fax", "call", "ruf an"])),
        ("number", f"{pick(DIG, 8)}{r.choice(['', '-'])}{pick(UP, 1)}", 1, r.choice(["NIF", "DNI", "nif:", "dni"])),
        ("number", r.choice([other, f"{pick(DIG, 8)}{pick(UP, 1)}"]), 0, r.choice([*count, "Rechnung", "commande", "pedido", "", ""])),
        ("key", r.choice(["AKIA", "ASIA"]) + pick(UP + DIG, 16), 1, ""),
        ("key", r.choice(["ghp_", "sk_live_", "xoxb_"]) + pick(LOW + UP + DIG, r.randint(20, 36)), 1, ""),
        ("key", pick(HEX, r.choice([32, 40, 64])), 1, r.choice(["token", "secret", "api key"])),
        ("key", pick(HEX, r.choice([32, 40, 64])), 0, r.choice([*count, ""])),
        ("key", f"{pick(LOW, r.randint(8, 14))}{r.choice(['_', ''])}{pick(LOW, r.randint(6, 10))}{r.randint(1, 99)}", 0, ""),
        ("key", f"{pick(LOW, 3)}_{pick(DIG, 4)}_{pick(LOW, 12)}", 0, ""),
        ("account", r.choice(["DE", "FR", "ES", "GB"]) + pick(DIG, 2) + "".join(r.choice(["", " "]) + pick(DIG, 4) for _ in range(r.randint(3, 5))), 1, ""),
        ("account", pick(UP, 2) + pick(DIG, 2) + pick(UP, 4) + pick(UP, 4), 0, r.choice([*count, ""])),
        ("spelt", f"{pick(LOW, 6)}{r.choice([' [at] ', '(at)', '[at]'])}{pick(LOW, 7)}{r.choice([' [dot] ', '(dot)', '.'])}{r.choice(['com', 'org', 'net'])}", 1, ""),
        ("spelt", f"{pick(LOW, r.randint(3, 9))} at {pick(LOW, r.randint(4, 9))} dot {r.choice(['com', 'org', 'net'])}", 1, r.choice(["write to", "mail", ""])),
        ("spelt", f"{pick(LOW, 2)} (at) {pick(LOW, 2)}. {pick(LOW, 5)}", 0, ""),
    ]


def _calibrating(r: random.Random) -> list[tuple[str, str, int, str]]:
    """The same from other words and forms, for the thresholds: nothing here is learnt from."""
    pick = lambda chars, k: _pick(r, chars, k)
    syllable = lambda n: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(n))
    person = ["social security no.", "telephone", "Fax:", "passport", "mobile no", "Phone", "her account", "cell phone", "taxpayer"]
    count = ["Order no.", "issue", "Version", "pages", "article", "batch", "commit", "model", "between"]
    sep = r.choice("-. ")
    grouped = r.choice([f"{pick(DIG, 3)}-{pick(DIG, 2)}-{pick(DIG, 4)}", f"{pick(DIG, 3)}{sep}{pick(DIG, 3)}{sep}{pick(DIG, 4)}"])
    word = f"{syllable(r.randint(3, 5))}"
    other = r.choice([f"0{r.randint(1, 9)}{pick(DIG, 2)}-{pick(DIG, r.randint(6, 8))}", f"0{r.randint(1, 9)}." + ".".join(pick(DIG, 2) for _ in range(4)), f"6{pick(DIG, 2)} {pick(DIG, 2)} {pick(DIG, 2)} {pick(DIG, 2)}"])
    return [
        ("number", grouped, 1, r.choice(person)),
        ("number", grouped, 0, r.choice(count)),
        ("secret", f"{r.choice(['Secret', 'apikey', 'PASSWORD', 'api-key', 'TOKEN', 'pwd'])}{r.choice(['=', ': ', ' ='])}{r.choice([pick(HEX, r.choice([16, 24, 40, 48])), syllable(3).title() + pick(DIG, 4) + r.choice('!?*'), pick(UP + LOW + DIG + '+/', 32) + '=='])}", 1, ""),
        ("secret", f"{r.choice(['Password', 'token', 'secret'])}: {word}{r.choice(['', '.', ','])}", 0, ""),
        ("secret", f"{r.choice(['passphrase', 'Kennwort', 'PASSWORD', 'CLIENT_SECRET', 'contrasena', 'access_key'])}{r.choice([' lautet ', ' est ', ': ', ' = ', r.choice(QUOTED)])}{syllable(3)}{pick(DIG, 3)}{r.choice('!_#x')}", 1, r.choice(["our", "mein", "votre"])),
        ("secret", f"{r.choice(['passphrase', 'Kennwort', 'contraseña', 'jeton'])}{r.choice([' is ', ' ist ', ' es ', ' est '])}{word}{r.choice(['', '.', ','])}", 0, r.choice(["this", "ein", "une"])),
        ("key", f"eyJ{pick(UP + LOW + DIG, 30)}.{pick(UP + LOW + DIG + '_-', 50)}.{pick(UP + LOW + DIG + '_-', 43)}", 1, r.choice(["jwt", "id", ""])),
        ("key", f"Bearer {pick(LOW + UP + DIG + '-_', r.randint(24, 48))}", 1, r.choice(["header", ""])),
        ("key", f"Bearer {syllable(r.randint(8, 11))}", 0, "one"),
        ("number", other, 1, r.choice(["téléphone", "teléfono", "Mobil", "portable", "Telefax", "Rufnummer"])),
        ("number", f"{r.choice('XYZ')}{pick(DIG, 7)}{pick(UP, 1)}", 1, r.choice(["NIF", "steuer id", "dni"])),
        ("number", r.choice([other, f"{pick(DIG, 8)}-{pick(UP, 1)}"]), 0, r.choice([*count, "Bestellung", "facture", "factura", "Seite", ""])),
        ("key", "AKIA" + pick(UP + "234567", 16), 1, r.choice(["id", "access", ""])),
        ("key", r.choice(["gho_", "pk_test_", "xoxp_", "ghp_"]) + pick(LOW + UP + DIG, r.randint(24, 40)), 1, ""),
        ("key", pick(HEX, r.choice([32, 48, 64])), 1, r.choice(["credential", "Token", "the secret"])),
        ("key", pick(HEX, r.choice([32, 40, 64])), 0, r.choice(["sha", "commit", "build", "md5", ""])),
        ("key", f"{syllable(4)}_{syllable(4)}_{r.randint(1, 9999)}", 0, ""),
        ("key", f"{syllable(3).title()}{syllable(3).title()}{syllable(3).title()}{r.randint(1, 99)}", 0, ""),
        ("account", f"{r.choice(['NL', 'IT', 'BE', 'CH', 'AT'])}{pick(DIG, 2)} " + " ".join(pick(DIG, 4) for _ in range(r.randint(3, 5))) + f" {pick(DIG, r.randint(1, 3))}", 1, r.choice(["iban", "to", "account"])),
        ("account", f"{pick(UP, 2)}{pick(DIG, 2)} {r.choice(['PART', 'TYPE', 'UNIT', 'ZONE'])} {pick(UP, 4)}", 0, r.choice(count)),
        ("spelt", f"{syllable(2)}.{syllable(2)}{r.choice([' [at] ', ' (at) ', '[at]'])}{syllable(3)}{r.choice([' (dot) ', '[dot]', '.'])}{r.choice(['edu', 'info', 'de'])}", 1, ""),
        ("spelt", f"{syllable(2)}.{syllable(2)} {r.choice(['at', 'arroba', 'arobase'])} {syllable(3)} {r.choice(['dot', 'punto', 'point'])} {r.choice(['es', 'fr', 'org'])}", 1, ""),
        ("spelt", f"{syllable(1)} (at) {syllable(1)}. {syllable(3)}", 0, ""),
    ]


def examples(n: int, seed: int, family=_learnt) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Made-up proposals with labels: kinds, features and whether they are private."""
    r = random.Random(seed)
    kinds, rows, labels = [], [], []
    for _ in range(n):
        for kind, value, label, word in family(r):
            words = " ".join(_pick(r, LOW, r.randint(2, 8)) for _ in range(4))
            before = f"{words} {word and word + ' '}"[-CONTEXT:]
            kinds.append(kind), rows.append(_features(kind, before, value)), labels.append(label)
    return kinds, np.array(rows), np.array(labels, float)


def threshold(margins: np.ndarray, truth: np.ndarray, precision: float) -> float:
    """Half way below the lowest score from which on, at any higher one too, at least ``precision`` of the examples are private; above all of them if there is none."""
    order = np.argsort(-margins, kind="stable")
    m, right = margins[order], np.cumsum(truth[order])
    last = np.append(m[1:] != m[:-1], True)  # equal scores are taken together
    good = right[last] >= precision * (np.flatnonzero(last) + 1)
    holds = int(good.argmin()) if not good.all() else len(good)
    steps = m[last]
    if not holds:
        return float(m[0]) + 1
    return float(steps[holds - 1 : holds + 1].mean())


@functools.cache
def model(precision: float = 0.98, n: int = 60) -> tuple[Boosted, dict[str, float]]:
    """The trees and, for each proposed kind, the threshold on their sum. Fitted here in about two seconds."""
    _, x, y = examples(n, 1)
    fitted = Boosted.fit(FEATURES, x, y, trees=TREES)
    kinds, x, y = examples(2 * n, 2, _calibrating)
    margins, own = fitted.margins(x).round(6), np.array(kinds)
    return fitted, {kind: threshold(margins[own == kind], y[own == kind], precision) for kind in PROPOSED}


_BLOCK = 256
_SPAN = "struct<s:int,k:int,e:int>"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``value`` under a name, worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scan(items: str, state: str, step: str, made: str, kind: str, last: str = "NULL") -> str:
    """SQL: an array made in one pass over ``items``, in time that grows with its length.

    ``state`` is what is known before the first item. ``step`` and ``made`` are said of the state ``st``, the item ``x`` and its place ``i`` from
    1: the next state, and an array of what the item adds. ``last``: an array of what the final state adds.
    An aggregate copies what it has made with each item, so items are taken in blocks, and blocks are joined at the end.
    """
    none = f"cast(array() AS array<{kind}>)"
    item = _let("x", "element_at(items, i)", _let("st", "a.st", f"named_struct('st', {step}, 'out', {_let('m', made, 'IF(size(m) = 0, a.out, concat(a.out, m))')})"))
    block = f"aggregate(sequence(n * {_BLOCK} + 1, least((n + 1) * {_BLOCK}, size(items))), named_struct('st', o.st, 'out', {none}), (a, i) -> {item})"
    joined = _let("b", block, "named_struct('st', b.st, 'out', IF(size(b.out) = 0, o.out, concat(o.out, array(b.out))))")
    finish = "flatten(o.out)" if last == "NULL" else f"{_let('st', 'o.st', f'concat(flatten(o.out), {last})')}"
    whole = f"aggregate(sequence(0, int((size(items) - 1) DIV {_BLOCK})), named_struct('st', {state}, 'out', cast(array() AS array<array<{kind}>>)), (o, n) -> {joined}, o -> {finish})"
    return _let("items", items, f"IF(size(items) = 0, {none}, {whole})")


def _matches(text: str, pattern: str) -> str:
    """SQL: array of (s, e, v, b): start, end, value, and the characters before it."""
    kind = "struct<s:int,e:int,v:string,b:string>"
    parts = f"split(regexp_replace({text}, {_quoted(pattern)}, '\\u0001$0\\u0001'), '\\u0001')"
    # every second part is a match
    made = f"IF(i % 2 = 0, array(named_struct('s', st, 'e', st + length(x), 'v', x, 'b', right(element_at(parts, i - 1), {CONTEXT}))), cast(array() AS array<{kind}>))"
    return _let("parts", parts, f"IF(size(parts) < 2, cast(array() AS array<{kind}>), {_scan('parts', '0', 'st + length(x)', made, kind)})")


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DIGITS = "transform({m}, c -> named_struct('s', c.s, 'e', c.e, 'd', regexp_replace(c.v, '[^0-9]', '')))"
_LUHN = """aggregate(sequence(1, length(c.d)), 0, (a, i) -> a + IF((length(c.d) - i) % 2 = 0, int(substr(c.d, i, 1)),
    int(substr(c.d, i, 1)) * 2 - IF(int(substr(c.d, i, 1)) > 4, 9, 0))) % 10 = 0"""


def _base(kind: str, text: str) -> str:
    m = _matches(text, BASE[kind])
    if kind == "ip":
        m = f"filter({m}, c -> c.v RLIKE '^{_PART}([.]{_PART}){{3}}$')"
    elif kind == "card":
        m = f"filter({_DIGITS.format(m=m)}, c -> length(c.d) BETWEEN 12 AND 19 AND {_LUHN})"
    elif kind == "phone":
        m = f"filter({_DIGITS.format(m=m)}, c -> length(c.d) BETWEEN 9 AND 15)"
    return f"transform({m}, c -> named_struct('s', c.s, 'k', {KINDS.index(kind)}, 'e', c.e))"


def _proposals(kind: str, text: str, trees: Boosted, cut: float) -> str:
    """SQL: array of (s, k, e, m): the kind's proposals that reach its threshold, with their scores."""
    scored = f"transform({_matches(text, PROPOSED[kind])}, c -> named_struct('s', c.s, 'e', c.e, 'f', {_feature_sql('c')}))"
    judged = f"transform({scored}, c -> named_struct('s', c.s, 'k', {KINDS.index(kind)}, 'e', c.e, 'm', {trees.sql('c.f')}))"
    return f"filter({judged}, c -> c.m >= {cut:.6f}D)"


def _settled(base: str, proposed: str) -> str:
    """SQL: the proposals that no base span holds; of two that overlap, the one that holds the other, else the higher score, else the first."""
    items = f"array_sort(concat(transform({base}, c -> named_struct('s', c.s, 'k', c.k, 'e', c.e, 'm', 0D)), {proposed}))"
    state = "named_struct('known', 0, 'held', cast(NULL AS struct<s:int,k:int,e:int,m:double>))"
    skipped = f"x.k < {len(BASE)} OR x.e <= st.known"
    apart = "st.held IS NULL OR x.s >= st.held.e"
    # spans come by their start: x holds the held one only from the same start on
    better = "x.s = st.held.s AND x.e > st.held.e OR x.e > st.held.e AND x.m > st.held.m"
    step = f"""IF({skipped}, named_struct('known', IF(x.k < {len(BASE)}, greatest(st.known, x.e), st.known), 'held', st.held),
        named_struct('known', st.known, 'held', IF({apart} OR {better}, x, st.held)))"""
    held = "array(named_struct('s', st.held.s, 'k', st.held.k, 'e', st.held.e))"
    made = f"IF(NOT ({skipped}) AND st.held IS NOT NULL AND x.s >= st.held.e, {held}, cast(array() AS array<{_SPAN}>))"
    return _scan(items, state, step, made, _SPAN, f"IF(st.held IS NULL, cast(array() AS array<{_SPAN}>), {held})")


def find_spans(docs: DataFrame, precision: float = 0.98, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, one array of (s, k, e) for each base kind, and ``added``: the chosen proposals outside base spans.

    s and e are code points from 0, e exclusive; k is the place in KINDS. ``keep``: columns to carry along.
    """
    trees, cuts = model(precision)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c) for c in keep), text.alias("text"))
    rows = rows.withColumn("marked", F.when(F.instr("text", "\x01") > 0, F.translate("text", "\x01", "\x02")).otherwise(F.col("text")))
    # what no match of a kind can lack is looked for first, at the price of a plain search
    needs = {"email": "instr(marked, '@') > 0", "phone": "instr(marked, '+') > 0", "spelt": "marked RLIKE '[(\\\\[]at[)\\\\]]| (?:dot|DOT|point|punto|punkt) '", "secret": f"marked RLIKE {_quoted(KEYED)}"}
    made = {k: (_base(k, "marked"), _SPAN) for k in BASE} | {k: (_proposals(k, "marked", trees, cuts[k]), "struct<s:int,k:int,e:int,m:double>") for k in PROPOSED}
    found = (F.expr(f"IF({needs.get(k, 'digits')}, {e}, cast(array() AS array<{kind}>))").alias(f"p_{k}") for k, (e, kind) in made.items())
    rows = rows.withColumn("digits", F.expr("marked RLIKE '[0-9]'")).select("doc_id", *keep, "text", *found)
    base = F.concat(*(F.col(f"p_{k}") for k in BASE))
    rows = rows.withColumn("base", F.array_sort(base)).withColumn("proposed", F.concat(*(F.col(f"p_{k}") for k in PROPOSED)))
    return rows.withColumn("added", F.expr(f"IF(size(proposed) = 0, cast(array() AS array<{_SPAN}>), {_settled('base', 'proposed')})"))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def pii_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = find_spans(docs, **options)
    return rows.select("doc_id", *(F.size(f"p_{k}").cast("long").alias(f"n_{k}") for k in BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


_PAGE = 1024


def _cut(a: str, b: str) -> str:
    """SQL: code points a to b of a text that stands in ``pages`` of a fixed length."""
    page, last = f"int({a} DIV {_PAGE})", f"int(({b} - 1) DIV {_PAGE})"
    one = f"substring(element_at(pages, {page} + 1), {a} % {_PAGE} + 1, {b} - {a})"
    more = f"concat(substring(element_at(pages, {page} + 1), {a} % {_PAGE} + 1), array_join(slice(pages, {page} + 2, {last} - {page} - 1), ''), substring(element_at(pages, {last} + 1), 1, ({b} - 1) % {_PAGE} + 1))"
    return f"CASE WHEN {b} <= {a} THEN '' WHEN {page} = {last} THEN {one} ELSE {more} END"


def redact(docs: DataFrame, keep: tuple[str, ...], **options) -> DataFrame:
    """The text with each span, or union of overlapping spans, replaced by its first kind in brackets."""
    rows = find_spans(docs, keep=keep, **options).withColumn("all", F.array_sort(F.concat("base", "added")))
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    made = f"IF(x.s >= st, array({_cut('st', 'x.s')}, element_at({names}, x.k + 1)), cast(array() AS array<string>))"
    parts = _scan("all", "0", "greatest(st, x.e)", made, "string", f"array({_cut('st', 'length(text)')})")
    whole = _let("pages", f"regexp_extract_all(text, '(?s).{{1,{_PAGE}}}+', 0)", f"array_join({parts}, '')")
    return rows.select("doc_id", *keep, F.expr(f"IF(size(all) = 0, text, {whole})").alias("text"))
