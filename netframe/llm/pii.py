"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, schemes, plus signs, digits and identifier
cues; from each anchor a small deterministic parser expands to the boundaries and validates.

Base kinds: email, ip (parts of at most 255), card (12 to 19 digits passing Luhn) and phone (9 to 15 digits), each leftmost
and non-overlapping within its kind; a failing match is dropped and the search goes on behind it. The method adds three kinds:
url (http, https and ftp addresses), account (a cue such as IBAN, SSN or passport with the identifier behind it: an IBAN must pass
its check digits, a social security number must have an area, group and serial that are given out, any other needs five digits)
and secret (a cue such as password or api key with the value that =, : or "is" assigns to it, of letters and digits; a bearer token; a key with its
vendor's prefix; a private key from its first line to its last, only the first where there is no last).

Defined cases: null text is the empty text, without spans. Every row has a result; repeated rows have equal ones, and ties can't
arise. Texts of any length are searched whole, in one pass over the anchors. An empty table has an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from netframe.llm.common import sliced, str_texts, text_frame

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "account", "secret")
KINDS = BASE_KINDS + ADDED_KINDS

SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "ssn", "social security", "account", "acct", "passport", "konto", "cuenta", "compte")
SECRETS = ("password", "passwd", "passphrase", "pwd", "token", "secret", "api_key", "apikey", "api-key", "api key", "access_key", "access key", "secret key")
BEARER, ARMOUR = "bearer ", "-----begin "
# fixed values: what keys of public services begin with
VENDORS = ("AKIA", "ASIA", "AIza", "sk_live_", "sk_test_", "rk_live_", "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat-", "xoxb-", "xoxp-")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s\"'<>]+")
_ACCOUNT = re.compile(r"(?:[\x20]*(?:no|number|nr|code|id))?[\x20]*[.:#=]?[\x20]*([A-Z]{0,3}[0-9](?:[\x20-]?[A-Z0-9]){4,33})(?![A-Za-z0-9])", re.ASCII)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}")
_SECRET = re.compile(r"[\"']?[\x20]*(?:=|:|\bis\b)[\x20]*[\"']?([A-Za-z0-9+/_.~-]{8,}=*)", re.ASCII)
_BEARER = re.compile(r"[\x20]*([A-Za-z0-9+/_.~-]{16,}=*)")
_VENDOR_KEY = re.compile(r"(?:A[KS]IA[A-Z0-9]{16}|(?!A[KS]IA)(?:" + "|".join(map(re.escape, VENDORS)) + r")[A-Za-z0-9_-]{16,})(?![A-Za-z0-9])")
_ARMOUR = re.compile(r"-----BEGIN (?:[A-Z0-9]+\x20){0,4}PRIVATE KEY-----")
_ARMOUR_END = re.compile(r"-----END [A-Z0-9\x20]{0,60}-----")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        n = int(x)
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def valid_account(cue: str, value: str) -> bool:
    """Whether an identifier behind a cue can be one. value: as it is written."""
    plain = value.replace(" ", "").replace("-", "")
    if _IBAN.fullmatch(plain):
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    if cue in ("ssn", "social security"):
        return _SSN.fullmatch(plain) is not None
    return cue != "iban" and sum(c.isdigit() for c in plain) >= 5


def anchors() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word, kind in [("@", "at"), ("+", "plus"), *((d, "digit") for d in "0123456789"), *((s, "scheme") for s in SCHEMES), *((c, "cue") for c in CUES), *((c, "secret") for c in SECRETS), *((v.lower(), "vendor") for v in VENDORS), (BEARER, "bearer"), (ARMOUR, "armour")]:
        made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


def _mixed(value: str) -> bool:
    """Letters and digits both: no plain word and no number."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


class Finder:
    """Expands the anchors of one text after another."""

    def __init__(self) -> None:
        self.anchors = anchors()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) by start, then as the kinds are listed."""
        found: list[tuple[int, int, str]] = []
        done = dict.fromkeys(KINDS, 0)  # where the search of a kind goes on
        self.no_armour_ends = False
        folded = text.lower()
        if len(folded) != len(text):  # a character that lower-cases to two; cues and schemes are ASCII
            folded = "".join(x.lower() if x < "\x80" else x for x in text)
        for end, (kind, n) in self.anchors.iter(folded):
            at = end - n + 1
            if kind == "digit":
                if at >= done["ip"] and (m := _IP.match(text, at)):
                    done["ip"] = m.end()
                    if all(int(x) <= 255 if len(x) < 4000 else int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split(".")):
                        found.append((*m.span(), "ip"))
                elif at >= done["ip"]:  # no start within these digits
                    done["ip"] = self._no_ip(text, at)
                if at >= done["card"]:
                    if m := _CARD.match(text, at):
                        done["card"] = m.end()
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 12 <= len(digits) <= 19 and luhn(digits):
                            found.append((*m.span(), "card"))
                    else:
                        done["card"] = at + 1
            elif kind == "at":
                start = at
                while start > done["email"] and text[start - 1] in _LOCAL_SET:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at)):
                    found.append((start, m.end(), "email"))
                    done["email"] = m.end()
            elif kind == "plus":
                if at >= done["phone"] and (m := _PHONE.match(text, at)):
                    done["phone"] = m.end()
                    if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                        found.append((*m.span(), "phone"))
            elif kind == "scheme":
                if at >= done["url"] and (m := _URL.match(text, end + 1)):
                    stop = len(m[0].rstrip(".,;:!?)]}")) + end + 1
                    done["url"] = m.end()
                    if stop > end + 1:
                        found.append((at, stop, "url"))
            elif kind == "cue":
                if at >= done["account"] and not (at and text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, end + 1)):
                    done["account"] = m.end()
                    if valid_account(folded[at : end + 1], m[1]):
                        found.append((*m.span(1), "account"))
            elif at >= done["secret"] and (span := self._secret(text, kind, at, end + 1)):
                found.append((*span, "secret"))
                done["secret"] = span[1]
        return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))

    def _secret(self, text: str, kind: str, at: int, behind: int) -> tuple[int, int] | None:
        """The secret of an anchor that begins at at and has behind behind it."""
        if kind == "armour":
            if not (m := _ARMOUR.match(text, at)):
                return None
            last = None if self.no_armour_ends else _ARMOUR_END.search(text, m.end())
            self.no_armour_ends = last is None  # nor behind this one
            return at, (last or m).end()
        if kind == "vendor":
            m = None if at and text[at - 1].isalnum() else _VENDOR_KEY.match(text, at)
            return m.span() if m else None
        m = (_BEARER if kind == "bearer" else _SECRET).match(text, behind)
        return m.span(1) if m and _mixed(m[1]) else None

    @staticmethod
    def _no_ip(text: str, at: int) -> int:
        """A match can't start in this run of digits if none starts at its head."""
        return _DIGITS.match(text, at).end()


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in sliced(batches):
            counts, sums, out = {k: [] for k in BASE_KINDS}, [], []
            for text in str_texts(batch):
                spans = finder.spans(text)
                base = [x for x in spans if x[2] in BASE_KINDS]
                for k in BASE_KINDS:
                    counts[k].append(sum(x[2] == k for x in base))
                sums.append(hashlib.sha256(listed(base).encode()).hexdigest())
                out.append(listed(spans))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(sums, pa.string()), pa.array(out, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return text_frame(docs).mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: str) -> str:
    """The text with each span (as listed by find_pii) replaced by its kind in brackets; overlapping spans become one."""
    cut = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x))
    out, at = [], 0
    for a, b, kind in cut:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
