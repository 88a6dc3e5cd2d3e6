"""Lexicons and Unicode-safe keyword matching (T03, T04, T05, J02 helpers).

A lexicon is normalised with the same cleaning as the text it is matched
against (decision D1), so a match is "the cleaned text contains the cleaned
entry as a whole-word sequence".  Matching probes a hash set: each token against
the one-word entries, and, where a token begins some longer entry, the two, three, ... words
from there against the entries of that length.  The cost follows the text's length, not
the number of entries.  ``pattern()`` gives the equivalent padded regex for SQL
engines (it is what the DuckDB oracles use).
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .._util import any_of, col_of

_NON_WORD = re.compile(r"[\W]+", re.UNICODE)
_R_PUNCT_CATS = ("Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po")


def normalise_word(w: str, style: str = "python") -> str:
    """Clean one lexicon entry like the text it will be matched against.

    ``python``: T01 (non-word runs -> space, trim, lower).
    ``r``: T02 (lower, punctuation -> space, collapse, trim).
    ``raw``: unchanged lower-case entry (reproduces the reference's Python
    scripts, where entries with punctuation can never match, D1).
    """
    if style == "raw":
        return w.lower()
    if style == "r":
        s = "".join(" " if unicodedata.category(ch) in _R_PUNCT_CATS else ch for ch in w.lower())
        return " ".join(s.split())
    return " ".join(_NON_WORD.sub(" ", w).split()).lower()


def _escape(w: str) -> str:
    # escape ASCII punctuation only: valid in both Java regex and RE2
    return "".join("\\" + ch if (ch.isascii() and not ch.isalnum() and ch != " ") else ch for ch in w)


@dataclass(frozen=True)
class Lexicon:
    name: str
    words: tuple
    style: str = "python"
    entries: tuple = field(init=False)

    def __post_init__(self):
        seen, out = set(), []
        for w in self.words:
            n = normalise_word(w, self.style)
            if n and n not in seen:
                seen.add(n)
                out.append(n)
        object.__setattr__(self, "entries", tuple(out))

    @classmethod
    def from_file(cls, name: str, path: str, style: str = "python") -> "Lexicon":
        """Load a lexicon from a file: one entry per line, in order, repeats kept
        in ``words``; lines that begin with ``#`` are comments."""
        with open(path, encoding="utf-8") as fh:
            words = [ln.strip() for ln in fh]
        return cls(name, tuple(w for w in words if w and not w.startswith("#")), style)

    @property
    def single(self) -> tuple:
        return tuple(w for w in self.entries if " " not in w and not _needs_regex(w))

    @property
    def by_length(self) -> dict:
        """The entries by their number of words."""
        out: dict[int, list] = {}
        for e in self.entries:
            out.setdefault(e.count(" ") + 1, []).append(e)
        return {n: tuple(out[n]) for n in sorted(out)}

    def __add__(self, other: "Lexicon") -> "Lexicon":
        return Lexicon(f"{self.name}+{other.name}", self.words + other.words, self.style)

    def pattern(self) -> str:
        """Padded whole-word alternation, for ``' ' || clean || ' '``."""
        return " (" + "|".join(_escape(w) for w in self.entries) + ") "

    def match(self, clean, tokens=None) -> Column:
        """Boolean, FALSE for a null/empty cleaned text."""
        return keyword_match(clean, self, tokens)

    def hits(self, tok) -> Column:
        """Number of distinct entries present in a token array (single words)."""
        return hit_count(tok, self)


def _needs_regex(w: str) -> bool:
    # entries that keep punctuation (R style) are matched by regex
    return any(not (ch.isalnum() or ch == "_") for ch in w)


def _token_array(clean, tokens) -> Column:
    return col_of(tokens) if tokens is not None else F.split(F.coalesce(col_of(clean), F.lit("")), " ")


def _begins(lex: Lexicon) -> tuple:
    """First words of the entries of several words."""
    return tuple(dict.fromkeys(e.split(" ")[0] for e in lex.entries if " " in e))


def _words_from(tok: Column, n: int) -> Column:
    """At each position of a token array the next ``n`` tokens, w0, w1, ... (null beyond the end)."""
    rest = [F.slice(tok, j + 1, F.greatest(F.size(tok) - j, F.lit(0))).alias(f"w{j}") for j in range(1, n)]
    return F.arrays_zip(tok.alias("w0"), *rest)


def _joined(z: Column, n: int) -> Column:
    return F.concat_ws(" ", *[z[f"w{j}"] for j in range(n)])


def keyword_match(clean, lex: Lexicon, tokens=None) -> Column:
    """T04.  ``tokens``: the cleaned text already split on spaces (a staged
    column), to avoid splitting the text again for every lexicon."""
    if not lex.entries:
        return F.lit(False)
    of = lex.by_length
    longer = [n for n in of if n > 1]

    def found(tok):
        parts = [F.exists(tok, lambda t: t.isin(*of[1]))] if 1 in of else []
        if longer:
            begins = _begins(lex)
            parts.append(F.exists(tok, lambda t: t.isin(*begins)) & F.exists(
                _words_from(tok, longer[-1]), lambda z: z["w0"].isin(*begins) & any_of([_joined(z, n).isin(*of[n]) for n in longer])))
        return any_of(parts)

    # bound once by the outer lambda, however often the parts refer to the tokens
    return F.coalesce(F.exists(F.array(_token_array(clean, tokens)), found), F.lit(False))


def matched_entries(clean, lex: Lexicon, tokens=None) -> Column:
    """The distinct entries of ``lex`` in a cleaned text, as an array."""
    if not lex.entries:
        return F.array().cast("array<string>")
    of = lex.by_length
    longer = [n for n in of if n > 1]

    def found(tok):
        parts = [F.filter(tok, lambda t: t.isin(*of[1]))] if 1 in of else []
        if longer:
            begins = _begins(lex)
            at = F.filter(_words_from(tok, longer[-1]), lambda z: z["w0"].isin(*begins))
            every = [e for n in longer for e in of[n]]
            parts.append(F.flatten(F.transform(at, lambda z: F.filter(F.array(*[_joined(z, n) for n in longer]), lambda g: g.isin(*every)))))
        return F.array_distinct(F.concat(*parts) if len(parts) > 1 else parts[0])

    return F.flatten(F.transform(F.array(_token_array(clean, tokens)), found))


def extend_match(flag, clean, lex: Lexicon) -> Column:
    """OR a supplemental lexicon into an existing match flag."""
    return F.coalesce(col_of(flag), F.lit(False)) | keyword_match(clean, lex)


def hit_count(tok, lex: Lexicon) -> Column:
    """Distinct single-word entries present in ``tok`` (array<string>)."""
    tok = col_of(tok)
    if not lex.single:
        return F.lit(0)
    return F.size(F.array_intersect(tok, F.array(*[F.lit(w) for w in lex.single])))


# ---------------------------------------------------------------------------
# FIXED VALUES: keyword lists that must equal the reference's for equal
# results, stated as text in their original order.  Lists above about 200
# entries (the base and extended climate lexicons) are not shipped here; pass
# them with ``Lexicon.from_file`` or ``Lexicon(name, words)``.
# ---------------------------------------------------------------------------
GENDER = (
    'abuse', 'abused', 'adolescent', 'adolescents', 'aids', 'antirotavirus', 'bodies', 'body',
    'boys', 'care', 'cedaw', 'child', 'childhood', 'children', 'daughter', 'equality',
    'exploitation', 'exploited', 'familien', 'families', 'family', 'female', 'feminism', 'feminist',
    'femmes', 'force', 'forced', 'frauenrechten', 'garçons', 'gbv', 'gender', 'genital',
    'genitals', 'girl', 'girls', 'haemophilius', 'haemophilus', 'hiv', 'inequality', 'jeunes',
    'könsbaserat', 'masculine', 'masculinity', 'maternal', 'menstrual', 'menstruation', 'misogyny', 'mother',
    'mothers', 'normative', 'pad', 'pads', 'patriarchy', 'period', 'periods', 'rape',
    'raped', 'reproduce', 'reproductive', 'sanitary', 'sex', 'sexism', 'sexospécifique', 'sexual',
    'sexueller', 'son', 'stem', 'tampon', 'tampons', 'tgnp', 'ungdomar', 'unwomen',
    'uterus', 'utérus', 'vaw', 'violence', 'violent', 'woman', 'women', 'wps',
    'young', 'youth', 'youths',
)

DISABILITY = (
    'accessible', 'accessibility', 'albino', 'albinism', 'autism', 'autistic', 'blind', 'blindness',
    'chronic', 'deaf', 'deafness', 'déficience', 'deformity', 'deformities', 'difficult', 'difficulty',
    'difficulties', 'dignified', 'disabilitazione', 'disabilities', 'disability', 'disable', 'disabled', 'discrimination',
    'eye', 'eyes', 'handicap', 'handicapped', 'handicapés', 'handicapées', 'hearing', 'helpage',
    'impaired', 'impairment', 'impairments', 'inclusion', 'inclusive', 'marginalization', 'marginalized', 'mental',
    'parkinson', 'physical', 'precondition', 'seeing', 'sight', 'stigma', 'stigmatisation', 'stigmatization',
    'taboo', 'vulnerability', 'vulnerable', 'wheelchair',
)

SUPPLEMENTAL_DISABILITY = (
    'albino', 'albinism', 'autism', 'autistic', 'chronic', 'deformity', 'deformities', 'déficience',
    'difficult', 'difficulty', 'difficulties', 'disable', 'eye', 'eyes', 'handicapés', 'handicapées',
    'helpage', 'impaired', 'impairment', 'impairments', 'inclusive', 'parkinson',
)

SUPPLEMENTAL_CLIMATE = (
    'clim', 'klimatanpassning', 'sequías', 'sequía', 'sequias', 'sequia', 'inundaciones', 'inun daciones',
    'inundación', 'inundacion', 'gef', 'adaption', 'climateshot', 'landdegradatie', 'catastrophic', 'risk insurance',
    'ndcs', 'global warming', 'cng', 'air', 'coal', 'cleaner', 'ozone', 'montreal',
    'paris', 'kyoto', 'energetica',
)

NEGATIVE_CLIMATE = (
    'no description', 'does not have',
)

STRONG_ADAPTATION = (
    'météorologiques', 'adaptative', 'risk insurance', 'sécheresse', 'météorologique', 'disaster risk', 'meteorology', 'sequia',
    'catastrophe', 'disaster', 'risk reduction', 'weather', 'meteorological', 'drought', 'flooding', 'drr',
    'early warning', 'catastrophes', 'flood', 'disasters', 'farmer', 'floods', 'preparedness', 'adaption',
    'rains', 'résilience', 'climatic', 'adaptive', 'resilience', 'climatiques', 'coping', 'crop',
    'agroecological', 'tolerant', 'season', 'sols', 'sequías', 'agroecology', 'adaptation', 'depleted',
    'watershed', 'catastrophic', 'seascape', 'drylands', 'farmers', 'rice', 'dessalement', 'sequía',
    'sequía', 'harvest', 'cgiar', 'harvests', 'agricoles', 'drm', 'resilient', 'agricole',
    'adapt', 'coastal', 'crops', 'ifad', 'lowlands', 'diversified', 'agriculture', 'inundaciones',
    'ecosystemen', 'soil', 'agricultural', 'pastorales', 'ccnucc', 'cultivos', 'agro', 'remote sensing',
    'écologiques', 'climat', 'flloca', 'cultures', 'environnementaux', 'zones', 'klimatanpassning', 'meteorológica',
    'diversifying', 'water', 'desert', 'terres', 'naturelles', 'meteorologiques', 'satellite', 'farm',
    'ocean', 'permaculture', 'climatique', 'zone', 'sequias', 'dryland', 'écosystèmes', 'marine',
    'environnementales', 'grazing', 'mitigating', 'natural', 'ecological', 'désert', 'durables', 'durablement',
    'climate', 'sea', 'farms', 'agri', 'ecosystems', 'ecology', 'agrícola', 'terre',
    'depletion', 'desalination', 'agroforestry', 'montane', 'organic', 'cultivo', 'ecologique', 'vegetation',
    'coffee', 'biodiversité', 'mangrove',
)

STRONG_MITIGATION = (
    'émissions', 'greening', 'carbon', 'clean', 'energi', 'lines', 'gaz', 'charcoal',
    'recycling', 'fuel', 'énergie', 'cleaner', 'deforestation', 'energia', 'ghg', 'hydroelectric',
    'railway', 'géothermique', 'recycle', 'decarbonization', 'montreal', 'efficiency', 'interconnexion', 'renouvelable',
    'biomass', 'greenhouse', 'power', 'renouvelables', 'gases', 'cng', 'energy', 'solaire',
    'gas', 'emission', 'emissions', 'railways', 'cement', 'hydropower', 'énergétique', 'cooking',
    'wind', 'transmission', 'hydroelectriques', 'solar', 'emisiones', 'solaires', 'retrofitting', 'energetica',
    'coal', 'geotermia', 'renewable', 'renewables', 'hydroélectrique', 'bioenergy', 'ozone', 'biomasa',
    'redd', 'biomasse', 'electric', 'batteries', 'electricity', 'electrification', 'interconnection', 'électrique',
    'grid', 'energie', 'grids', 'emisión', 'geothermal', 'electricité', 'energies', 'photovoltaic',
    'electrique', 'battery', 'pv', 'mw', 'windpower', 'batterie', 'solarization', 'transmisión',
)

# ---------------------------------------------------------------------------


def shipped() -> dict:
    """The shipped lexicons by name (Python-style normalisation)."""
    return {
        "gender": Lexicon("gender", GENDER),
        "disability": Lexicon("disability", DISABILITY),
        "supplemental_disability": Lexicon("supplemental_disability", SUPPLEMENTAL_DISABILITY, "r"),
        "supplemental_climate": Lexicon("supplemental_climate", SUPPLEMENTAL_CLIMATE, "r"),
        "negative_climate": Lexicon("negative_climate", NEGATIVE_CLIMATE, "r"),
        "strong_adaptation": Lexicon("strong_adaptation", STRONG_ADAPTATION, "r"),
        "strong_mitigation": Lexicon("strong_mitigation", STRONG_MITIGATION, "r"),
    }
