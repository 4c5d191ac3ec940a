"""Technical / Formulation / Unknown, from how a registration describes its product."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import fold_accents, strip

# Words, codes and figures that tell a technical from a formulated product.
TECHNICAL_WORDS = r"(?iU)\b(technical|tech|tc|tk|tg)\b"
FORMULATION_CODES = (
    r"(?U)\b(EC|SC|SL|SP|WP|WG|WDG|OD|SG|GR|CS|DC|EW|ME|FS|ZC|ZW|SE|GB|DP|EO)\b"
)
FORMULATION_NAMES = (
    r"concentrat|emulsi|suspens|wettable|mojable|soluble|granul|dispersa|"
    r"powder|polvo|\bdust\b|flowable|capsul|aerosol|tablet|pastilla|\bgel\b|"
    r"\bbait\b|cebo|\bpaste\b|pasta|berbentuk|tepung|larutan|butiran|cair|"
    r"herbicid|insecticid|fungicid|adjuvant|parasiticid|acaricid|rodenticid|"
    r"nematicid|molluscicid|pestisid|fungisid|herbisid|insektisid|rodentisid|"
    r"akarisid|moluskisid|nematisid|seed treatment|tratamiento"
)
LIQUID_STRENGTH = r"(?i)\d+(?:[.,]\d+)?\s*(?:g|kg)\s*/\s*l\b"
PERCENT = r"(\d{1,3}(?:[.,]\d+)?)\s*%"
GRAMS_PER_KG = r"(?i)(\d{2,4})\s*g\s*/\s*kg"
PURE_PERCENT = 90
PURE_GRAMS = 900


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))


def category(product: Column, ingredient: Column, concentration: Column,
             formulation: Column) -> Column:
    """The first rule that applies decides; the order of the branches is the rule order."""
    form = strip(F.coalesce(formulation, F.lit("")))
    folded = F.lower(fold_accents(form))
    blob = _joined(concentration, ingredient, product)
    percent = F.replace(F.regexp_extract(blob, PERCENT, 1), F.lit(","), F.lit("."))
    grams = F.regexp_extract(blob, GRAMS_PER_KG, 1)
    technical, formulated = F.lit("Technical"), F.lit("Formulation")
    return (F.when(folded == "technical", technical)
            .when(folded == "formulation", formulated)
            .when(folded.contains("active constituent"), technical)
            .when(_joined(formulation, product).rlike(TECHNICAL_WORDS), technical)
            .when(ingredient.contains("+"), formulated)
            .when(F.upper(form).rlike(FORMULATION_CODES), formulated)
            .when(folded.rlike(FORMULATION_NAMES), formulated)
            .when(blob.rlike(LIQUID_STRENGTH), formulated)
            .when(percent.try_cast("double") >= PURE_PERCENT, technical)
            .when(grams.try_cast("int") >= PURE_GRAMS, technical)
            .otherwise("Unknown"))
