"""Quality rules: line-first cleaning, then rules on what is left of a document.

Each line is held against the punctuation, navigation and boilerplate rules; lines that fail are removed; a document that
loses too many of its words, or that fails the base rules on the whole text, is rejected.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import map_rows

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Phrases of page furniture in English, German, French and Spanish, matched in lower case within a line of few words.
BOILERPLATE = (
    "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "accept cookies", "we use cookies",
    "enable javascript", "javascript is disabled", "click here", "read more", "sign in", "sign up", "log in", "subscribe to our newsletter",
    "share this", "follow us", "back to top", "skip to content", "lorem ipsum", "page not found", "powered by", "leave a comment", "related articles",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "impressum", "cookies akzeptieren", "wir verwenden cookies", "javascript aktivieren", "hier klicken", "weiterlesen",
    "jetzt anmelden", "konto erstellen", "newsletter abonnieren", "beitrag teilen", "folgen sie uns", "nach oben", "zum inhalt springen", "seite nicht gefunden",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "mentions légales", "accepter les cookies", "nous utilisons des cookies", "activer javascript", "cliquez ici", "lire la suite",
    "se connecter", "créer un compte", "abonnez-vous", "partager cet article", "suivez-nous", "retour en haut", "aller au contenu", "page introuvable",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "aviso legal", "aceptar cookies", "utilizamos cookies", "habilitar javascript", "haga clic aquí", "leer más",
    "iniciar sesión", "crear una cuenta", "suscríbete", "comparte este", "síguenos", "volver arriba", "saltar al contenido", "página no encontrada",
)


@dataclass(frozen=True)
class Rules:
    """Thresholds. Shares are of words unless they say otherwise."""

    min_words: int = 20
    max_repeat_percent: int = 30
    #: A line fails with symbols at the ends of more than this share of its words ...
    max_marked: float = 0.3
    #: ... or exclamation and question marks on more than this share, in at least so many words ...
    max_shouted: float = 0.4
    min_line_words: int = 4
    #: ... or separators of navigation between more than this share of its words ...
    max_separators: float = 0.25
    #: ... or words that repeat the word before them, above this share ...
    max_stuttered: float = 0.5
    #: ... or a phrase of page furniture, where the line has at most so many words.
    furniture_words: int = 15
    #: A document that loses more than this share of its words with its lines is rejected.
    max_lost: float = 0.5


PHRASE = re.compile("|".join(map(re.escape, BOILERPLATE)))
MARKED = re.compile(r"[#*$%&<>]{2,}(?=[ \t\v\f\r]|$)|(?:^|(?<=[ \t\v\f\r]))[#*$%&<>]{2,}")
SHOUTED = re.compile(r"[!?]{2,}(?=[ \t\v\f\r]|$)")
SEPARATOR = re.compile(r"(?:^|(?<=[ \t\v\f\r]))(?:[|>»›·•/\\]|--+)(?=[ \t\v\f\r]|$)")


def line_fault(line: str, words: list[bytes], rules: Rules) -> str | None:
    """The first rule that a line fails: 'marked', 'shouted', 'navigation', 'stuttered', 'furniture' or None."""
    n_words = len(words)
    if n_words >= rules.min_line_words:
        if any(c in line for c in SYMBOLS):
            if len(MARKED.findall(line)) > rules.max_marked * n_words:
                return "marked"
        if ("!!" in line or "??" in line or "!?" in line) and len(SHOUTED.findall(line)) > rules.max_shouted * n_words:
            return "shouted"
        if len(SEPARATOR.findall(line)) > rules.max_separators * n_words:
            return "navigation"
        if sum(map(eq, words, words[1:])) > rules.max_stuttered * n_words:
            return "stuttered"
    if n_words <= rules.furniture_words and PHRASE.search(line.lower()):
        return "furniture"
    return None


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows of so many words that occur twice or more, the first included.

    Windows are compared by a 64-bit hash of their words' hashes; those with an equal are compared word by word.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    order = np.argsort(mixed, kind="stable")
    sorted_mixed = mixed[order]
    same = sorted_mixed[1:] == sorted_mixed[:-1]
    if not same.any():
        return 0
    inside = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    maybe = order[inside]
    # Windows of one hash are compared with the first of them, a word at a time, so that no window is ever held whole.
    start = np.maximum.accumulate(np.where(np.concatenate(([True], ~same))[inside], np.arange(len(maybe)), 0))
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    equal = np.ones(len(maybe), bool)
    for k in range(window):
        equal &= ids[maybe + k] == ids[maybe[start] + k]
    again = np.ones(len(maybe), bool)
    if not equal.all():  # hashes met by chance: in their groups alone windows are counted as they are
        mixed_groups = np.isin(start, start[~equal])
        times = Counter(tuple(ids[i : i + window].tolist()) for i in maybe[mixed_groups].tolist())
        again[mixed_groups] = [times[tuple(ids[i : i + window].tolist())] > 1 for i in maybe[mixed_groups].tolist()]
    edge = np.bincount(maybe[again], minlength=len(words) + 1) - np.bincount(maybe[again] + window, minlength=len(words) + 1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None, rules: Rules = Rules()) -> dict:
    """All counts, the cleaned text and both verdicts of one document. A null text counts as empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    n_repeat = repeated_words(words)
    seen: set[str] = set()
    kept_lines, n_dup, lost, n_failed = [], 0, 0, 0
    for line in text.split("\n"):
        in_line = line.encode("utf-8", "surrogatepass").split()
        n_line = len(in_line)
        if not n_line:
            kept_lines.append(line)
            continue
        again = line in seen
        seen.add(line)
        n_dup += again
        if line_fault(line, in_line, rules):
            lost += n_line
            n_failed += 1
        else:
            kept_lines.append(line)
    base_failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words
    return {
        "n_words": n_words,
        "word_chars": len(text) - sum(text.count(c) for c in SPACES),
        "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": not base_failed and lost <= rules.max_lost * n_words,
        "n_failed_lines": n_failed,
        "n_lost_words": lost,
        "clean_text": "\n".join(kept_lines) if n_failed else text,
    }


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long, n_lost_words long"


def assess(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the measures of every whole text and the SHA-256 of the text without its failed lines, in one narrow pass.

    Null and empty texts fail the base rules, and have the digest of the empty text.
    """

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            found = measure(row["text"], rules)
            found["clean_sha256"] = hashlib.sha256(found.pop("clean_text").encode("utf-8", "surrogatepass")).hexdigest()
            yield {"doc_id": row["doc_id"]} | found

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, {MEASURES}, clean_sha256 string")


def clean(docs: DataFrame, rules: Rules = Rules(), drop_lines: bool = False) -> DataFrame:
    """The documents that pass, with all their columns; with drop_lines, without the lines that fail.

    n_chars, where the documents have it, follows the text. Extra columns go through unchanged.
    """
    names, kinds = docs.columns, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            found = measure(row["text"], rules)
            if found["kept"]:
                if drop_lines and found["n_failed_lines"]:
                    row["text"] = found["clean_text"]
                    if "n_chars" in names:
                        row["n_chars"] = len(row["text"])
                yield row

    return map_rows(docs, run, kinds)
