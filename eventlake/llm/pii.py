"""Personal data: exact base spans, and further spans from boosted candidates.

Generators of high recall propose spans that may overlap: the base formats, long digit groups, account and social
numbers, spelt-out e-mail addresses, IPv6 addresses, values given to a name like token or password, and long opaque
strings. Boosted trees score each candidate by its format and by the words and characters around it. Base spans always
stay; other candidates are taken by falling probability where they reach their kind's threshold and overlap no span that
is taken. As no table labels personal data, the trees are fitted on texts made here from a seed, and thresholds are
calibrated, for a precision of at least 0.98 in each kind, on texts from other templates in other words and languages.

All generators take time in proportion to the text, whatever it holds.

Defined results: a null or empty text has no spans and the digest of the empty string; null doc_ids and repeated rows are
rows like others; an empty table gives no rows; other columns are ignored by `find` and kept by `redacted`.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees
from .common import map_texts, table, texts_of

KINDS = ("email", "ip", "card", "phone")
MORE = ("email_spelt", "phone_local", "social", "account", "ip6", "secret", "opaque")
PRECISION = 0.98

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SOCIAL = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_LOCAL_PHONE = re.compile(r"(?<![\w+.,-])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,5}){1,4}(?![\w,-]|\.[0-9])")
_SPELT = re.compile(r"[A-Za-z0-9._+-]{1,64} ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]{1,63}(?: ?[\[({] ?dot ?[\])}] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,4}", re.I)
_IP6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])")
_AT = re.compile(r"[\[({] ?at ?[\])}]", re.I)
_GIVEN = re.compile(r"(?:token|secret|key|passwor[dt]|passwd|pwd|credential|bearer|kennwort|contraseña|clave|passe)s?[\"']?[ \t]{0,2}(?:=>|:=|=|:|[ \t])[ \t]{0,2}[\"']?([^\s\"']{8,})", re.I)
_OPAQUE = re.compile(r"(?<![\w+/-])[A-Za-z0-9+/_-]{20,}={0,2}(?![\w+/=-])")

#: Words before a span that speak for or against personal data, by what they name.
CUES = {
    "phone": "phone tel telephone call mobile cell fax whatsapp contact telefon handy anruf appel teléfono móvil téléphone portable ring",
    "card": "card visa mastercard amex credit debit payment karte carte tarjeta",
    "mail": "mail email e-mail correo courriel contact write",
    "person": "ssn social security passport tax iban account bank konto compte cuenta identity born patient customer konto",
    "secret": "token secret key password passwort passwd pwd apikey auth bearer credential credentials access private signing passphrase kennwort schlüssel contraseña clave passe clé",
    "digest": "commit sha sha1 sha256 md5 checksum hash digest blob tree revision etag uuid guid prüfsumme somme suma fingerprint",
    "host": "ip address host server client login from addr",
    "thing": "version release order invoice isbn issn item part model serial ticket page pages chapter section build no number figure table total price sum date year id ref sku doi",
}
_CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of the e-mail pattern: its local part is the run of characters before an @, since the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1  # a run never goes back over an @
        if found:
            out.append((start, done))
        at = text.find("@", done)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base(text: str) -> list[tuple[str, int, int]]:
    """The base spans in order of start, then kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans of further formats; they may overlap each other and the base spans."""
    out = [("phone_local", *m.span()) for m in _LOCAL_PHONE.finditer(text) if 7 <= len(_digits(m[0])) <= 15]
    out += [("social", *m.span()) for m in _SOCIAL.finditer(text)]
    out += [("account", *m.span()) for m in _ACCOUNT.finditer(text)]
    if text.count(":") >= 2:
        out += [("ip6", *m.span()) for m in _IP6.finditer(text)]
    for m in _GIVEN.finditer(text):
        value = m[1].rstrip(".,;:!?)]}>#*$&%")
        if len(value) >= 8:
            out.append(("secret", m.start(1), m.start(1) + len(value)))
    out += [("opaque", *m.span()) for m in _OPAQUE.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]
    for m in _AT.finditer(text):  # the pattern is tried around the mark only
        if found := next((x for x in _SPELT.finditer(text, max(0, m.start() - 66), min(len(text), m.end() + 330)) if x.start() < m.start() < x.end()), None):
            out.append(("email_spelt", *found.span()))
    return out


def described(text: str, kind: str, start: int, end: int) -> list[float]:
    """Features of a candidate: its format, then its context."""
    span = text[start:end]
    digits = _digits(span)
    groups = re.findall(r"[0-9]+", span)
    before = [w.lower() for w in _WORDS.findall(text[max(0, start - 48) : start])][-5:]
    near = [len(_CUES[k].intersection(before)) for k in CUES]
    last = 1.0 if before and before[-1] in _CUES["thing"] else 0.0
    left, right = text[start - 1 : start], text[end : end + 1]
    return [
        *(float(kind == k) for k in MORE),
        len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        span.count("-"), span.count("."), span.count(" "), span.count("/"), span.count(":"), float("(" in span),
        len(set(digits)) / max(1, len(digits)), float(digits[:1] == "0"), float(luhn(digits)) if digits else 0.0,
        sum(c.isalpha() for c in span) / len(span), float(_mod97(span)) if kind == "account" else 0.0, float(_date(groups)),
        float(span.rsplit(".", 1)[-1].isalpha()), *map(float, near), last,
        _entropy(span), sum(c in "0123456789abcdefABCDEF" for c in span) / len(span), _turns(span) / len(span), float(span.isalpha()),
        float(left in ("'", '"')), float(text[max(0, start - 4) : start].rstrip(" \"'").endswith(("=", ":", "=>"))),
        float(left in "$€£#%=" and left != ""), float(right in "%€$£°" and right != ""), float(left in ":\n" and left != ""),
    ]


def _entropy(span: str) -> float:
    """Bits for each character, by the span's own."""
    n = np.array(list(Counter(span).values())) / len(span)
    return float(-(n * np.log2(n)).sum())


def _turns(span: str) -> int:
    """How often the kind of character changes: digit, small letter, capital, other."""
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "o" for c in span]
    return sum(x != y for x, y in zip(kinds, kinds[1:], strict=False))


def _mod97(account: str) -> bool:
    s = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _date(groups: list[str]) -> bool:
    return len(groups) == 3 and (len(groups[0]) == 4 and 1900 <= int(groups[0]) < 2100 or len(groups[2]) == 4 and 1900 <= int(groups[2]) < 2100) and all(int(g) <= 31 for g in groups if len(g) < 4)


class _Maker:
    """Spans of each kind from a seed, personal or only alike, and the texts around them."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, k: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(k))

    def word(self) -> str:
        return "".join(self.r.choice("abcdefghilmnoprstuv") for _ in range(self.r.randint(2, 9)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def hexes(self, k: int) -> str:
        return "".join(self.r.choice("0123456789abcdef") for _ in range(k))

    def letters(self, k: int, extra: str = "") -> str:
        return "".join(self.r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + extra) for _ in range(k))

    def account(self, good: bool, lands: tuple[str, ...]) -> str:
        body, land = self.digits(self.r.choice((14, 18, 20))), self.r.choice(lands)
        check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
        s = f"{land}{check if good else (check + self.r.randint(1, 90)) % 97:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if self.r.random() < 0.5 else s

    def date(self) -> str:
        r = self.r
        return r.choice((f"{r.randint(1900, 2099)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{r.randint(1900, 2099)}", f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1900, 2099)}"))


def _fit_example(m: _Maker, kind: str, good: bool) -> tuple[str, str]:
    """A text to fit on, and its span: a word that speaks for or against it, then the span."""
    r, d, word = m.r, m.digits, m.word
    cue = {"email_spelt": "mail", "phone_local": "phone", "social": "person", "account": "person", "ip6": "host", "secret": "secret", "opaque": "secret"}[kind]
    sep = r.choice(" -./")
    if kind == "email_spelt":
        span = f"{word()}{r.choice((' [at] ', '(at)', ' (at) '))}{word()}{r.choice((' [dot] ', '.', '(dot)'))}{r.choice(('com', 'org', 'de', 'net'))}" if good else f"{word()} (at) {word()}.{d(2)}"
    elif kind == "phone_local":
        span = r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(4)}/{d(5)}")) if good else r.choice((m.date(), f"{d(3)} {d(3)} {d(3)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(4)}{sep}{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"{d(5)} {d(5)}"))
    elif kind == "social":
        span = f"{d(3)}-{d(2)}-{d(4)}"
    elif kind == "account":
        span = m.account(good, ("DE", "FR", "ES", "GB", "NL"))
    elif kind == "ip6":
        span = ":".join(f"{r.getrandbits(16):x}" for _ in range(8)) if good else f"{d(2)}::{d(2)}"
    elif kind == "secret":
        span = r.choice((m.hexes(r.choice((32, 40, 64))), m.letters(r.randint(16, 48), "_-"), m.letters(r.randint(10, 16), "!?%&_"))) if good else r.choice((word() + word() + "ed", (word() + word()).title() + "s", f"{word().title()}'s-{word()}", f"{word()}.{word()}", m.date(), word() + "-" + word() + "-" + word(), f"{word()}_{word()}", d(8)))
        name = r.choice(("token", "secret", "api_key", "password", "access_key", "auth_token"))
        tie = r.choice((" = ", "=", ": ", " ")) if good or r.random() < 0.5 else " "
        quote = r.choice(('"', "'", "")) if "=" in tie else ""
        return f"{m.words(1, 6)} {name if r.random() < 0.7 else name.upper()}{tie}{quote}{span}{quote} {m.words(1, 5)}.", span
    else:
        span = r.choice((m.hexes(r.choice((32, 40, 64))), m.letters(r.randint(24, 60), "+/"), r.choice(("sk", "pk", "ghp")) + "_" + m.letters(r.randint(24, 40)))) if good else r.choice((m.hexes(r.choice((32, 40, 64))), "-".join((m.hexes(8), m.hexes(4), m.hexes(4), m.hexes(4), m.hexes(12))), "-".join(word() for _ in range(6)) + "-" + d(2), "/".join(word() for _ in range(5)) + "/" + d(4), word() + "_" + word() + "_" + word() + "_" + word() + d(2)))
    lead = r.choice(CUES[cue].split()) if good and (kind in ("phone_local", "social", "opaque") or r.random() < 0.6) else r.choice(CUES["digest" if kind == "opaque" else "thing"].split()) if not good and (kind == "opaque" or r.random() < 0.6) else word()
    lead = lead if r.random() < 0.7 else f"{lead}{r.choice((':', ' is', ' no', ' at'))}"
    return f"{m.words(1, 8)} {lead} {span} {m.words(1, 6)}.", span


#: Frames of the texts that calibrate, personal and alike.
_FRAMES = {
    "email_spelt": (("please write to {} before monday", "Kontakt: {}", "mi correo es {}, gracias", "écrivez à {} svp"), ("we met {} in the hall", "chapter {} of the book", "see {} there")),
    "phone_local": (("call me at {} tomorrow", "Tel. {} (abends)", "my mobile {} is always on", "Rufen Sie {} an: Telefon {}", "móvil {}", "ring {} and ask for Ann"), ("the invoice {} was paid", "on {} we opened", "order no {} has shipped", "page {} of the report", "{} units were sold", "Seite {}", "total {} km")),
    "social": (("her ssn is {} she said", "social security number {}", "patient {} was born in May", "tax id {}"), ("part number {} fits", "model {} is sold out", "serial {} of the item", "see ticket {}")),
    "account": (("please pay to IBAN {}", "mein Konto {} bei der Bank", "cuenta {}", "account: {}"), ("article {} is in stock", "ref {} expired", "the code {} does nothing")),
    "ip6": (("logged in from {}", "host {} is down", "server address {}", "client {} timed out"), ("the ratio was {}", "at {} it rang", "score {}")),
    "secret": (('export TOKEN="{}"', "the password is wrong: password: {}", 'config.secret = "{}"', 'la token = "{}" los', "clave: {}", "Authorization: Bearer {}", 'PRIVATE_KEY={}', 'api key "{}"'), ("the key {} was lost", "a token {} of thanks", "no secret {} here", "Passwort {} vergessen", "this is the key {} we need", "every password {} matters")),
    "opaque": (("use the api credentials {} to sign", "signing secret {}", "Schlüssel {} nicht weitergeben", "access via {} only, the private token"), ("git commit {} fixed it", "sha256 {} of the file", "Prüfsumme {}", "uuid {}", "the path {} is gone", "md5 checksum {}")),
}


def _held_example(m: _Maker, kind: str, good: bool) -> tuple[str, str]:
    """A text to calibrate on, and its span: sentences of several languages around shapes of their own."""
    r, d, word = m.r, m.digits, m.word
    if kind == "email_spelt":
        span = f"{word()}.{word()} {r.choice(('(at)', '{at}', '[AT]'))} {word()}-{word()}.{r.choice(('fr', 'es', 'info', 'com'))}" if good else f"{word()} (at) {d(3)}.{d(1)}"
    elif kind == "phone_local":
        span = r.choice((f"({d(3)}) 555-{d(4)}", f"0{d(2)}/{d(3)} {d(3)}", f"0{d(3)}-{d(5)}", f"{d(3)}.555.{d(4)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}")) if good else r.choice((m.date(), f"{d(4)} {d(4)}", f"{d(3)} {d(3)} {d(2)}", f"{d(2)}-{d(5)}", f"{d(3)}.{d(3)}.{d(3)}"))
    elif kind == "social":
        span = f"{d(3)}-{d(2)}-{d(4)}"
    elif kind == "account":
        span = m.account(good, ("IT", "BE", "AT", "CH", "PL"))
    elif kind == "ip6":
        span = r.choice((":".join(f"{r.getrandbits(16):04x}" for _ in range(8)), f"fe80::{r.getrandbits(16):x}:{r.getrandbits(16):x}:{r.getrandbits(16):x}")) if good else f"{d(1)}::{d(2)}"
    elif kind == "secret":
        span = r.choice((m.hexes(r.choice((40, 48))), m.letters(r.randint(20, 40)), f"{word().title()}{d(3)}!{m.letters(4)}", m.letters(22, "-_") + "==")) if good else r.choice((word() + word() + "ing", word().title() + "-" + word() + word(), "http://" + word() + "." + word(), f"({word()}{word()}s)"))
    else:
        span = r.choice((m.hexes(48), m.letters(r.randint(30, 44), "+/"), "xoxb_" + m.letters(30))) if good else r.choice((m.hexes(40), m.hexes(64), "-".join((m.hexes(8), m.hexes(4), m.hexes(4), m.hexes(4), m.hexes(12))), "/".join((word(), word(), word(), "v" + d(1), word() + d(2), word())), "_".join((word(), word(), word(), word(), d(4)))))
    frame = r.choice(_FRAMES[kind][0 if good else 1])
    return f"{m.words(0, 5)} {frame.replace('{}', span, 1).replace('{}', word())} {m.words(0, 4)}", span


def examples(n: int = 4000, seed: int = 11, held: bool = False) -> list[tuple[str, int, int, str, int]]:
    """Made texts with one candidate each: text, start, end, kind, whether it is personal data."""
    m, make, made = _Maker(seed), _held_example if held else _fit_example, []
    while len(made) < n:
        kind, good = m.r.choice(MORE), m.r.random() < 0.5
        text, span = make(m, kind, good)
        at = text.index(span)
        if found := [c for c in candidates(text) if c[0] == kind and c[1] < at + len(span) and c[2] > at]:
            made.append((text, found[0][1], found[0][2], kind, int(good)))
    return made


def _described(made: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([described(t, k, a, b) for t, a, b, k, _ in made]), np.array([e[4] for e in made], np.float64), np.array([e[3] for e in made])


def fit(n: int = 4000, seed: int = 11, precision: float = PRECISION) -> tuple[trees.Boosted, dict[str, float]]:
    """The trees, fitted on n made texts, and for each kind the lowest threshold that is precise enough on n // 2 texts of the
    other templates, 0.5 at least, as half of these texts are personal; above 1, so that it is never reached, where none is."""
    x, y, _ = _described(examples(n, seed))
    model = trees.fit(x, y)
    x, y, kinds = _described(examples(n // 2, seed + 1, held=True))
    p, cuts = model.probability(x), {}
    for kind in MORE:
        own = kinds == kind
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        last = np.append(p[own][order][1:] < p[own][order][:-1], True)  # equal probabilities are taken together
        good = np.flatnonzero((right >= precision) & last)
        cuts[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1
    return model, cuts


def spans(texts: list[str], model: trees.Boosted, cuts: dict[str, float]) -> list[tuple[list, list]]:
    """For each text its base spans and all spans."""
    found = [(base(t), candidates(t)) for t in texts]
    flat = [(i, c) for i, (_, more) in enumerate(found) for c in more]
    p = model.probability(np.array([described(texts[i], *c) for i, c in flat])) if flat else []
    by: dict[int, list] = {}
    for (i, c), q in zip(flat, p, strict=True):
        if q >= cuts[c[0]]:
            by.setdefault(i, []).append((-q, c))
    out = []
    for i, (own, _) in enumerate(found):
        every = list(own)
        for _, c in sorted(by.get(i, [])):
            if all(c[2] <= s[1] or c[1] >= s[2] for s in every):
                every.append(c)
        out.append((own, sorted(every, key=lambda s: (s[1], (KINDS + MORE).index(s[0])))))
    return out


def _joined(found: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame) -> DataFrame:
    """Per document: counts and digest of the base spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(fit())  # sixty small trees

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = spans([t or "" for t in batch["text"].to_pylist()], *shared.value)
        counts = [pa.array([sum(s[0] == k for s in own) for own, _ in found], pa.int64()) for k in KINDS]
        return pa.record_batch([batch["doc_id"], *counts, pa.array([hashlib.sha256(_joined(own).encode()).hexdigest() for own, _ in found], pa.string()), pa.array([_joined(every) for _, every in found], pa.string()), pa.array([len(every) for _, every in found], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return map_texts(docs, one, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def blacked(text: str, found: list) -> str:
    """text with each span replaced by its kind; spans that overlap are one, of the first's kind."""
    out, at = [], 0
    for kind, a, b in found:
        if a >= at:
            out += [text[at:a], f"[{kind.split('_')[0].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with personal data in `column` replaced; nulls stay."""
    shared, schema, at = docs.sparkSession.sparkContext.broadcast(fit()), docs.schema, docs.columns.index(column)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        found = spans([t or "" for t in texts], *shared.value)
        columns = list(batch.columns)
        columns[at] = pa.array([t if t is None else blacked(t, every) for t, (_, every) in zip(texts, found, strict=True)], batch.schema.field(at).type)
        return pa.record_batch(columns, schema=batch.schema)

    return map_texts(docs, one, schema, column)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(texts_of(table(spark, sf_dir, "documents")))
