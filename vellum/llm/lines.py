"""Quality rules, line first.

Each line is judged alone: navigation, symbols, shouting, boilerplate phrases, a
missing end mark, repetition of an earlier line.  Failing lines are removed; a
document that loses more than `max_loss` of its words is rejected.  The counts of
the base (n_dup_lines and so on) are always over the whole text as it came.

Documents are read once and never shuffled; a text is held one at a time, a long one
as its words and its distinct lines.

Nulls and texts without words have 0 counts and fail the base.  Lines end at \\n;
a \\r before it belongs to no word.  Rows that repeat are judged alike.  A share of
exactly the limit breaks a line's rule; a loss of exactly max_loss is kept.  An empty
table gives an empty result.  Only the id and the text are read, whatever other
columns are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import small_batches, utf8

SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Lone words that part the entries of a navigation line (fixed values).
SEPARATORS = ("|", "/", ">", "*", "»", "›", "•", "·")
#: Marks that end a line of prose, and what may close after them (fixed values).
ENDS, CLOSERS = ".!?:;…。！？", "\"'”’»)]"
#: Phrases of pages rather than of prose, in English, German, French and Spanish (fixed values).
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here", "read more", "sign in", "log in", "subscribe to our newsletter", "share on facebook", "javascript", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookie-richtlinie", "hier klicken", "klicken sie hier", "weiterlesen", "newsletter abonnieren", "auf facebook teilen",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "conditions générales", "mentions légales", "cliquez ici", "lire la suite", "abonnez-vous à notre newsletter", "partager sur facebook",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "términos de uso", "condiciones de uso", "aviso legal", "haga clic aquí", "leer más", "suscríbete a nuestro boletín", "compartir en facebook",
)
#: Words that entries of a navigation line are made of, in the same languages (fixed values).
NAVIGATION = frozenset(
    "home about contact blog news login logout register search menu sitemap help faq products services shop cart account "
    "startseite über uns kontakt aktuelles anmelden abmelden registrieren suche suchen menü hilfe produkte leistungen warenkorb konto impressum "
    "accueil propos actualités connexion déconnexion inscription recherche rechercher aide produits boutique panier compte "
    "inicio acerca nosotros contacto noticias entrar salir registrarse buscar menú ayuda productos servicios tienda carrito cuenta".split()
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds; a line fails if one of its shares is at or over the limit."""

    bar_share: float = 0.15  #: of words that are lone separators (navigation)
    symbol_share: float = 0.3  #: of words that hold a symbol
    shout_share: float = 0.6  #: of words in capitals that end in two exclamation marks
    boilerplate_words: int = 40  #: a longer line that holds a boilerplate phrase is prose about it
    plain_words: int = 8  #: a line of so many words ends in a mark
    nav_words: int = 12  #: a line of at most so many words, all but one of them of navigation, is navigation
    max_loss: float = 0.5
    boilerplate: tuple[str, ...] = field(default=BOILERPLATE)
    separators: tuple[str, ...] = field(default=SEPARATORS)
    navigation: frozenset[str] = field(default=NAVIGATION)

    def fails(self, line: bytes, words: list[bytes]) -> str | None:
        """The name of the first rule that the line breaks."""
        n = len(words)
        bars = {s.encode() for s in self.separators}
        if sum(w in bars for w in words) >= self.bar_share * n:
            return "navigation"
        if 3 <= n <= self.nav_words and sum(w.decode("utf-8", "replace").lower() in self.navigation for w in words) >= n - 1:
            return "navigation"
        if line.translate(None, SYMBOLS) != line and sum(w.translate(None, SYMBOLS) != w for w in words) >= self.symbol_share * n:
            return "symbols"
        if b"!!" in line and sum(w.endswith(b"!!") and (t := w.decode("utf-8", "replace")) == t.upper() for w in words) >= self.shout_share * n:
            return "shouting"
        if n <= self.boilerplate_words and any(p in low for low in [line.decode("utf-8", "surrogatepass").lower()] for p in self.boilerplate):
            return "boilerplate"
        if n >= self.plain_words and not words[-1].decode("utf-8", "replace").rstrip(CLOSERS).endswith(tuple(ENDS)):
            return "punctuation"
        return None


def judge(text: str | None, rules: LineRules) -> tuple:
    """Base counts, verdicts, the number of words kept and the cleaned text."""
    raw = utf8(text)
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, True, False, 0, None if text is None else ""
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    tri = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(tri)) < len(tri):
        often, end = {t for t, c in Counter(tri).items() if c > 1}, 0
        for i, t in enumerate(tri):
            if t in often:
                repeated += i + 3 - max(i, end)
                end = i + 3
    seen: set[bytes] = set()
    dup = lost = 0
    good: list[bytes] = []
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            good.append(line)
            continue
        if line in seen:
            dup += 1
            lost += len(own)
            continue
        seen.add(line)
        if rules.fails(line, own):
            lost += len(own)
        else:
            good.append(line)
    failed = n < 50 or 100 * repeated > 50 * n
    kept = not failed and lost <= rules.max_loss * n
    return n, chars, symbols, dup, repeated, failed, kept, n - lost, b"\n".join(good).decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, rules: LineRules | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, words_left and cleaned."""
    rules = rules or LineRules()
    small_batches(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left"] + ["cleaned"] * with_text
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.string()] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t, rules)[: len(names)] for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, words_left long" + ", cleaned string" * with_text
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)
