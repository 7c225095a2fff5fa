"""Personal data: expressions propose spans, checksums confirm them, context words adjust scores."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from signalspark.llm.textmap import with_text_columns

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = 4
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# a match can only begin where a run of digits does, and takes whole runs
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_DIGIT = re.compile("[0-9]")
#: Score of a confirmed span by itself, and words that raise it when near.
SCORES = {"email": 0.9, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8}
CONTEXT = {
    "email": ("mail", "contact", "contacto", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "telefon", "telefono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
}
_WORD = re.compile(r"[^\W\d_]+")
NEAR, RAISE = 40, 0.2


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Check digits of an international account number without blanks."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Leftmost matches of local part, @ and dotted domain, found from the @ signs.

    The local part is the longest run before the @ that no earlier match took,
    so a long run without an @ costs nothing.
    """
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def cards(text: str):
    for m in _CARD.finditer(text):
        d = digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            yield m.span()


def phones(text: str):
    for m in _PHONE.finditer(text):
        if 10 <= len(digits(m[0])) <= 15:
            yield m.span()


def ibans(text: str):
    """Account numbers; letters after a blank may be the next word, so shorter ends are tried too."""
    for m in _IBAN.finditer(text):
        s = m[0]
        for end in [len(s), *(i for i in range(len(s) - 1, 0, -1) if s[i] == " ")]:
            account = s[:end].replace(" ", "")
            if 15 <= len(account) <= 34 and mod97(account):
                yield m.start(), m.start() + end
                break


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans of a whole text as (kind, start, end, score), by start, then kind as in ``KINDS``."""
    if not text:
        return []
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(a, 1, b) for a, b in ips(text)]
        found += [(a, 2, b) for a, b in cards(text)]
        found += [(a, 3, b) for a, b in phones(text)] if "+" in text else []
        found += [(a, 4, b) for a, b in ibans(text)]
    out = []
    for a, k, b in sorted(found):
        near = _WORD.findall(text[max(0, a - NEAR) : a].lower() + " " + text[b : b + NEAR].lower())
        raised = any(w in CONTEXT[KINDS[k]] for w in near)
        out.append((KINDS[k], a, b, round(min(1.0, SCORES[KINDS[k]] + RAISE * raised), 2)))
    return out


def redact(text: str | None, spans: list[tuple[str, int, int, float]], least: float = 0.0) -> str | None:
    """Replace spans of at least that score by ``<KIND>``; where spans overlap, the first stays."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b, score in spans:
        if score >= least and a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = b
    return "".join([*out, text[at:]])


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def scan(
    documents: DataFrame, text: str = "text", keep: list[str] | None = None, least: float = 0.5, with_text: bool = False
) -> DataFrame:
    """Find personal data in every whole text.

    Adds ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base kinds), ``n_iban``,
    ``base_sha256`` and ``spans`` (kind:start:end by start, in code points), the
    largest ``top_score``, ``scored`` (array of kind, start, end, score) and, if
    asked, the ``redacted`` text.  Base kinds stay whatever their score; others
    need ``least``.  A null text counts as empty: no spans, no top score.  Row
    by row: repeated rows repeat, an empty table stays empty, null ids pass,
    and columns of these names are replaced.  No shuffle.
    """

    def task():
        def run(texts):
            rows = []
            for t in texts:
                spans = [s for s in find(t) if s[0] in KINDS[:BASE] or s[3] >= least]
                base = [s for s in spans if s[0] in KINDS[:BASE]]
                row = [sum(s[0] == k for s in spans) for k in KINDS]
                row += [hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)]
                row.append(max((s[3] for s in spans), default=None))
                row.append([dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans])
                rows.append(row + ([redact(t, spans, least)] if with_text else []))
            return list(zip(*rows, strict=True)) if rows else [[] for _ in range(9 + with_text)]

        return run

    fields = (
        "n_email long, n_ip long, n_card long, n_phone long, n_iban long, base_sha256 string, spans string, "
        "top_score double, scored array<struct<kind:string,start:long,end:long,score:double>>"
    )
    return with_text_columns(documents, task, fields + ", redacted string" * with_text, text, keep)
