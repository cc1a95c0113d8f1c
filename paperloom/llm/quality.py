"""Quality rules, line first.

Every line is judged by itself; lines that fail go; a document that loses too
much of its text, or fails the base counts, is rejected. Free style: one Arrow
pass, no shuffle, memory of one text at a time.

Line rules (a line without a word is kept as it is and counts for nothing):

* punctuation: the line ends in none of TERMINAL, and has fewer than
  `min_unpunctuated` words or stands in a text where more than
  `max_unpunctuated` of the longer lines end so (a few are headings or items,
  many are no prose);
* navigation: most of its words are separators (SEPARATORS), or it is a run of
  at least three one-or-two-word items parted by them, or it ends in no TERMINAL
  and at least `min_menu` of its three or more words are menu words;
* boilerplate: it holds one of the phrases (lower case; BOILERPLATE has a list for
  each language, another table may be given), and has fewer than
  `max_boilerplate_words` words;
* symbols: more than `max_symbols` symbol characters a word;
* shouting: at least `min_shout_words` words, over `max_upper` of them in upper
  case.

Defined results: a null text gives zero counts, fails the base and has a null
clean text; an empty text the same with an empty clean text; repeated rows and
ties each give their own row; null ids stay null; further columns of the input
are untouched (quality_rules) and may have any name; one that has the added
name is replaced.
"""

from __future__ import annotations

import re
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_rows, table

TERMINAL = tuple(".!?…:;,\"'”’»)]}。！？।")
SEPARATORS = frozenset("| / > » · • - – — :: >> « <".split())
BOILERPLATE = {
    "en": ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "we use cookies", "accept cookies", "enable javascript", "skip to content", "skip to main", "sign up for", "log in to", "click here", "read more", "share this", "follow us", "back to top", "powered by", "lorem ipsum"),
    "de": ("alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "wir verwenden cookies", "cookies akzeptieren", "zum inhalt springen", "hier klicken", "weiterlesen", "folgen sie uns", "nach oben", "newsletter abonnieren"),
    "fr": ("tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "nous utilisons des cookies", "accepter les cookies", "aller au contenu", "cliquez ici", "lire la suite", "suivez-nous", "haut de page"),
    "es": ("todos los derechos reservados", "términos de uso", "política de privacidad", "utilizamos cookies", "aceptar cookies", "saltar al contenido", "haga clic aquí", "leer más", "síguenos", "volver arriba"),
}
MENU = frozenset("home about contact contacts login logout register products services cart menu search help faq blog news sitemap account checkout subscribe download support careers startseite kontakt anmelden abmelden produkte warenkorb suche hilfe impressum datenschutz accueil connexion produits panier recherche aide boutique inicio contacto acceder productos carrito buscar ayuda tienda".split())
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
ITEMS = re.compile(r" [|»·•>/] ")

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_bad_lines long, lost double, reason string"


def held(data: bytes, ascii_chars: bytes) -> int:
    return len(data) - len(data.translate(None, ascii_chars))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    first: dict[bytes, int] = {}
    ids = np.array(list(map(first.setdefault, words, count())), np.int64)
    if n < 1 << 21:
        codes = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:  # three of these ids don't fit one integer
        codes = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1][:-1] * n + ids[2:]
    order = np.argsort(codes)
    same = np.diff(codes[order]) == 0
    again = np.zeros(n - 2, bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= again
    return int(hit.sum())


def ended(line: str) -> bool:
    return line.rstrip().endswith(TERMINAL)


def line_fault(line: str, open_text: bool = False, min_unpunctuated: int = 4, max_boilerplate_words: int = 30, max_symbols: float = 0.5, min_shout_words: int = 5, max_upper: float = 0.7, min_menu: float = 0.6, boilerplate: dict[str, tuple[str, ...]] = BOILERPLATE) -> str | None:
    """The first rule that the line fails; None if it stays. open_text: too many
    lines of its text end in no TERMINAL."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    if held(line.encode("utf-8", "surrogatepass"), SYMBOLS) > max_symbols * n:
        return "symbols"
    if n > 2 and not SEPARATORS.isdisjoint(words) and (sum(w in SEPARATORS for w in words) * 3 >= n or (len(items := ITEMS.split(line)) >= 3 and all(len(x.split()) <= 2 for x in items))):
        return "navigation"
    if n < max_boilerplate_words:
        low = line.lower()
        if any(x in low for phrases in boilerplate.values() for x in phrases):
            return "boilerplate"
    if n >= min_shout_words:
        if sum(map(str.isupper, words)) > max_upper * n:
            return "shouting"
    if not ended(line):
        if n > 2 and sum(w.lower() in MENU for w in words) >= min_menu * n:
            return "navigation"
        if n < min_unpunctuated or open_text:
            return "punctuation"
    return None


def judge(text: str | None, min_words: int = 50, max_repeat: int = 50, max_lost: float = 0.5, max_unpunctuated: float = 0.5, **rules) -> tuple:
    """(clean text, then COUNTS)."""
    if text is None:
        return None, 0, 0, 0, 0, 0, True, False, 0, 0, 0.0, "base"
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes.split() parts at exactly the contract's white space
    n = len(words)
    chars = len(text) - held(data, WHITE)
    symbols = held(data, SYMBOLS)
    lines = text.split("\n")
    seen: set[str] = set()
    dup, bad, kept, lost = 0, 0, [], 0
    prose = [ended(x) for x in lines if len(x.split()) >= rules.get("min_unpunctuated", 4)]
    open_text = prose.count(False) > max_unpunctuated * len(prose)
    for line in lines:
        if line.strip(" \t\x0b\x0c\r"):
            if line in seen:
                dup += 1
            seen.add(line)
        if line_fault(line, open_text, **rules):
            bad += 1
            lost += len(line)
        else:
            kept.append(line)
    repeat = repeat_words(words)
    base = n < min_words or 100 * repeat > max_repeat * n
    share = lost / max(1, len(text))
    reason = "base" if base else "lost" if share > max_lost else None
    return "\n".join(kept), n, chars, symbols, dup, repeat, base, reason is None, len(lines), bad, share, reason


def quality_rules(docs: DataFrame, verdict: str = "kept", **rules) -> DataFrame:
    """docs with the clean text in text, n_chars after it, and the verdict in a
    column of that name (in place of one that the input has); rows keep their
    other columns."""
    keep = [c for c in docs.columns if c not in ("text", "n_chars", verdict)]

    def make():
        def each(text, *rest):
            out = judge(text, **rules)
            return (*rest, out[0], None if out[0] is None else len(out[0]), out[7])

        return each

    fields = [docs.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField(verdict, T.BooleanType())]
    return map_rows(docs, ["text", *keep], T.StructType(fields), make).select(*(c for c in docs.columns if c != verdict), verdict)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        return lambda doc_id, text: (doc_id, *judge(text)[1:])

    return map_rows(table(spark, sf_dir, "documents"), ["doc_id", "text"], f"doc_id long, {COUNTS}", make).drop("lost")
