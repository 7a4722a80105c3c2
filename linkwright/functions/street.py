"""Street names brought to one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkwright.functions.step import Step
from linkwright.functions.text import squeeze
from linkwright.functions.translit import transliterate

__all__ = ["STREET_TYPES", "STREET_SUFFIXES", "STREET_PARTICLES", "normalize_street"]

# The spellings that results are compared by (language, written form, result).
FIXED_FORMS = [
    ("de", "STR", "STRASSE"),
    ("en", "ST", "STREET"),
    ("en", "BLVD", "BOULEVARD"),
    ("fr", "BD", "BOULEVARD"),
    ("es", "AVDA", "AVENIDA"),
    ("it", "P", "PIAZZA"),
    ("pt", "AV", "AVENIDA"),
    ("pl", "UL", "ULICA"),
    ("tr", "CAD", "CADDE"),
    ("sv", "GATAN", "GATA"),
]

# Abbreviations that postal services recommend, a small choice for each language: USPS Publication 28 appendix C1
# and Royal Mail (en), Deutsche Post and DIN 5008 (de), AFNOR NF Z10-011 (fr), Correos and INE road types (es),
# Poste Italiane (it), CTT (pt), Poczta Polska (pl), NEN 5825 (nl), PTT (tr), PostNord (sv, da). "FORM: ABBREVIATIONS".
_POSTAL = {
    "en": "ALLEY: ALY / AVENUE: AVE AV / CIRCLE: CIR / CLOSE: CL / COURT: CT / CRESCENT: CRES / CROSSING: XING / DRIVE: DR / EXPRESSWAY: EXPY / GARDENS: GDNS / GROVE: GRV / HIGHWAY: HWY / LANE: LN / PARKWAY: PKWY / PLAZA: PLZ / ROAD: RD / SQUARE: SQ / TERRACE: TER / TRAIL: TRL / TURNPIKE: TPKE",
    "de": "CHAUSSEE: CH / DAMM: D / GASSE: G / PLATZ: PL / PROMENADE: PROM / UFER: U",
    "fr": "ALLEE: ALL / AVENUE: AV / CHEMIN: CHE / COURS: CRS / FAUBOURG: FG / IMPASSE: IMP / LOTISSEMENT: LOT / PASSAGE: PAS / PLACE: PL / RESIDENCE: RES / ROUTE: RTE / SQUARE: SQ / VILLA: VLA",
    "es": "BARRIO: BRO / CALLE: CL / CALLEJON: CJON / CAMINO: CMNO / CARRETERA: CTRA / GLORIETA: GTA / PASAJE: PSJE / PASEO: PSO / PLAZA: PZA / POLIGONO: POLIG / RONDA: RDA / TRAVESIA: TRVA / URBANIZACION: URB",
    "it": "BORGO: BGO / CONTRADA: CDA / CORSO: CSO / LARGO: LGO / LOCALITA: LOC / STRADA: STR / VIA: V / VIALE: VLE / VICOLO: VIC",
    "pt": "ALAMEDA: AL / BAIRRO: BR / ESTRADA: ESTR / LARGO: LG / PRACA: PC / PRACETA: PCT / RODOVIA: ROD / RUA: R / TRAVESSA: TV / URBANIZACAO: URB",
    "pl": "ALEJA: AL / OSIEDLE: OS / PLAC: PL / RONDO: RD / SKWER: SKW",
    "nl": "DREEF: DR / GRACHT: GR / KADE: KD / LAAN: LN / PLEIN: PLN / SINGEL: SNGL / STRAAT: STR / WEG: WG",
    "tr": "BULVAR: BULV BLV / CADDE: CD / MAHALLE: MAH / MEYDAN: MEYD / SOKAK: SK SOK",
    "sv": "GRAND: GR / TORG: T / VAG: VAGEN",
    "da": "ALLE: ALL / GADE: GD / PLADS: PL / STRAEDE: STR / VEJ: V",
}


def _types() -> dict[str, dict[str, tuple[str, ...]]]:
    out: dict[str, dict[str, tuple[str, ...]]] = {}
    for lang, variant, full in FIXED_FORMS:
        here = out.setdefault(lang, {})
        here[full] = (*here.get(full, ()), variant)
    for lang, entries in _POSTAL.items():
        here = out.setdefault(lang, {})
        for entry in entries.split(" / "):
            full, short = entry.split(": ")
            here[full] = (*here.get(full, ()), *short.split())
    return out


#: Language, then spelled-out form, then the abbreviations of it that stand alone.
STREET_TYPES = _types()

#: Endings that stand for a type where the language is known: compounds are written in one word.
STREET_SUFFIXES: dict[str, dict[str, str]] = {
    "de": {"STR": "STRASSE", "STRASSE": "STRASSE", "PL": "PLATZ"},
    "nl": {"STR": "STRAAT", "LN": "LAAN", "PLN": "PLEIN"},
    "sv": {"GATAN": "GATA", "VAGEN": "VAG"},
    "da": {"GD": "GADE"},
}

#: Articles and prepositions of place, by the grammar of each language.
STREET_PARTICLES: dict[str, str] = {
    "da": "af den det i paa til ved",
    "de": "am an auf bei dem den der des die das hinter im in unter vor zu zum zur",
    "en": "at by in of on the upon",
    "es": "al de del el en la las los",
    "fr": "a au aux de des du en la le les sur",
    "it": "al da dei del della delle di il la nel",
    "nl": "aan bij de den der het op te ter van",
    "pt": "a ao da das de do dos em no na o",
    "sv": "av den det i pa till vid",
}


def normalize_street(
    lang: str | None = None,
    drop_house_numbers: bool = False,
    drop_stopwords: bool = False,
    types: dict[str, dict[str, tuple[str, ...]]] | None = None,
    suffixes: dict[str, dict[str, str]] | None = None,
    particles: dict[str, str] | None = None,
) -> Step:
    """Upper-case ASCII tokens with street types spelled out.

    A token that is a known variant becomes its canonical form; else, with ``lang`` only,
    the longest known ending does. House numbers are tokens that begin with a digit;
    particles are dropped after the types are spelled out. Null stays null.
    """
    types, suffixes, particles = types or STREET_TYPES, suffixes if suffixes is not None else STREET_SUFFIXES, particles or STREET_PARTICLES
    langs = [lang] if lang else list(types)
    exact: dict[str, str] = {}
    for la in langs:
        for canonical, variants in types.get(la, {}).items():
            for v in variants:
                exact.setdefault(v.upper(), canonical)
    endings = sorted(suffixes.get(lang, {}).items(), key=lambda x: -len(x[0])) if lang else []
    words = sorted({w.upper() for la in ([lang] if lang else particles) for w in particles.get(la, "").split()})
    known = F.create_map(*[F.lit(x) for kv in exact.items() for x in kv]) if exact else None

    def canonical_of(t: Column) -> Column:
        out = t
        for ending, full in reversed(endings):
            out = F.when(F.endswith(t, F.lit(ending.upper())), F.concat(F.substr(t, F.lit(1), F.length(t) - len(ending)), F.lit(full))).otherwise(out)
        return out if known is None else F.coalesce(F.try_element_at(known, t), out)

    def fn(c: Column) -> Column:
        t = squeeze(F.regexp_replace(F.upper(transliterate(c, "Any-Latin; Latin-ASCII")), "[^A-Z0-9 ]", " "))
        tokens = F.split(t, " ")
        if drop_house_numbers:
            tokens = F.filter(tokens, lambda x: ~x.rlike("^[0-9]"))
        tokens = F.transform(tokens, canonical_of)
        if drop_stopwords and words:
            tokens = F.filter(tokens, lambda x: ~x.isin(words))
        return F.array_join(tokens, " ")

    return Step("normalize_street", fn, args=(("lang", lang), ("drop_house_numbers", drop_house_numbers), ("drop_stopwords", drop_stopwords)))
