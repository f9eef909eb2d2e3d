"""Column expressions; each takes and returns columns, none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The twenty amino acids.
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLU": "E", "GLN": "Q", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
WATER = "HOH"


def _group(c: Column, pattern: str, k: int = 1) -> Column:
    found = F.regexp_extract(c, pattern, k)
    return F.when(found != "", found)


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def aa_position(c: Column) -> Column:
    """First number of a protein change such as ``p.R273C``; null without one."""
    return _group(c, r"p\.\D\D*(\d+)\D*").cast("int")


def aa_parts(c: Column) -> Column:
    """``ref, pos, alt`` of a protein change; null if it does not read as one."""
    pattern = r"p\.(\D*)(\d+)(\D*)"
    parts = F.struct(F.regexp_extract(c, pattern, 1).alias("ref"), _group(c, pattern, 2).cast("int").alias("pos"), F.regexp_extract(c, pattern, 3).alias("alt"))
    return F.when(c.rlike(pattern), parts)


def search_aa_position(c: Column) -> Column:
    """Position for the search step: a residue and a number, or an in-frame insertion; null for unexpected formats."""
    return F.coalesce(_group(c, r"p\.\w\D*(\d+)"), _group(c, r"(?i)p\.\D*(\d+)in_frame_ins")).cast("int")


def mutation_key(gene: Column, chromosome: Column, start: Column, stop: Column) -> Column:
    return F.concat_ws(":", gene, chromosome, start.cast("string"), stop.cast("string"))


def ref_alt_key(ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", ref, alt)


def protein_key(transcript: Column, aa_change: Column) -> Column:
    return F.concat_ws(":", transcript, aa_change)


def pair_key(a: Column, b: Column) -> Column:
    """One key for both orders of a pair."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def key_parts(c: Column) -> Column:
    return F.split(c, ":")


def structure_key(pdb: Column, chain1: Column, chain2: Column, structure_dependent: bool, subunit_dependent: bool) -> Column:
    """What a distance belongs to: the structure, the structure and its two chains in order, or ``any``."""
    if subunit_dependent:
        return F.concat_ws(":", pdb, F.least(chain1, chain2), F.greatest(chain1, chain2))
    return pdb if structure_dependent else F.lit("any")


def decode_info(c: Column) -> Column:
    """``"d pdb p|d pdb p|"`` as an array of (distance, pdb, p_value); empty parts are dropped."""
    part = lambda s: F.split(F.trim(s), " ")
    return F.transform(
        F.filter(F.split(c, r"\|"), lambda s: F.trim(s) != ""),
        lambda s: F.struct(F.get(part(s), F.lit(0)).try_cast("double").alias("distance"), F.get(part(s), F.lit(1)).alias("pdb"), F.get(part(s), F.lit(2)).try_cast("double").alias("p_value")),
    )


def encode_info(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x["distance"].cast("string"), x["pdb"], x["p_value"].cast("string"))), "|")


def strip_chain(c: Column) -> Column:
    return F.regexp_replace(c, r"[\[\]]", "")


def null_is_zero(c: Column) -> Column:
    return F.when(c == "N/A", F.lit("0")).otherwise(c)


def num_only(c: Column) -> Column:
    """Strips what surrounds a negative number; other text stays as it is."""
    return F.when(c == "N/A", F.lit("0")).otherwise(F.regexp_replace(c, r"^\D*(-[\d.]+)\D*", "$1"))


def residue_letter(c: Column) -> Column:
    """One-letter name; what is no amino acid stays."""
    return F.coalesce(_lookup(F.upper(c), RESIDUES), c)


def residue_code(c: Column) -> Column:
    """Three-letter name; what is no amino acid stays."""
    return F.coalesce(_lookup(F.upper(c), {v: k for k, v in RESIDUES.items()}), c)


def is_aa(c: Column) -> Column:
    return F.upper(c).isin(list(RESIDUES)) | F.upper(c).isin(list(RESIDUES.values()))


def is_water(c: Column) -> Column:
    return c == WATER


def round_thousandth(x: Column) -> Column:
    """Half a thousandth is added, then the fourth decimal is cut off toward zero; the inner round absorbs float noise."""
    y = x + F.lit(0.0005)
    return F.signum(y) * F.floor(F.round(F.abs(y) * 1000, 9)) / 1000


def euclidean(x1: Column, y1: Column, z1: Column, x2: Column, y2: Column, z2: Column) -> Column:
    return round_thousandth(F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) + (z1 - z2) * (z1 - z2)))


def linear_distance(u1: Column, pos1: Column, off1: Column, u2: Column, pos2: Column, off2: Column) -> Column:
    """Residues apart along the same protein; null between proteins."""
    return F.when(u1 == u2, F.abs((pos1 + off1) - (pos2 + off2)))


def hgvs_g(chromosome: Column, start: Column, stop: Column, ref: Column, alt: Column) -> Column:
    """``chr:g.start-stop ref>alt`` without the blank; parts that are null are left out."""
    span = F.when(stop.isNotNull() & (stop != start), F.concat(F.lit("-"), stop.cast("string"))).otherwise(F.lit(""))
    change = F.when(ref.isNotNull() & alt.isNotNull(), F.concat(ref, F.lit(">"), alt)).otherwise(F.lit(""))
    return F.concat(chromosome, F.lit(":g."), start.cast("string"), span, change)


def clean_domain(c: Column) -> Column:
    """Evidence tags go; nothing and ``N/A`` become ``NULL``."""
    bare = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r" ?\{ECO.*$", ""))
    return F.when(bare.isin("", "N/A"), F.lit("NULL")).otherwise(bare)


def sample_id(c: Column) -> Column:
    return _group(c, r"(TCGA-\w\w-\w\w\w\w)")


def normalize_chr(c: Column) -> Column:
    """``X``, ``Y`` or the number of a chromosome or band name; null if there is none."""
    return _group(F.regexp_replace(F.upper(c), r"CHR|[_\s]", ""), r"^(X|Y|\d+)")


def same_chr(a: Column, b: Column) -> Column:
    return normalize_chr(a) == normalize_chr(b)


def same_major_band(a: Column, b: Column) -> Column:
    """Same chromosome and arm, bands at most one apart; ``ter`` and ``cen`` fall back to the chromosome."""
    arm = lambda c: _group(c, r"([pq])(?:\d|ter)")
    band = lambda c: _group(c, r"[pq](\d+)").cast("int")
    known = band(a).isNotNull() & band(b).isNotNull()
    return same_chr(a, b) & F.when(known, (arm(a) == arm(b)) & (F.abs(band(a) - band(b)) <= 1)).otherwise(F.lit(True))


def ranges_overlap(s1: Column, e1: Column, s2: Column, e2: Column, tolerance: int = 0) -> Column:
    """Whether two ranges, each in either order, overlap within a tolerance; null if a bound is missing."""
    known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    return F.when(known, (F.greatest(s2, e2) + tolerance > F.least(s1, e1)) & (F.least(s2, e2) - tolerance < F.greatest(s1, e1)))


def closeness_term(w: Column, d: Column) -> Column:
    return w / F.pow(F.lit(2.0), d)


def exponential_term(w: Column, d: Column, weight_scale: float = 20.0, length_scale: float = 10.0) -> Column:
    return w * F.exp(F.abs(w / weight_scale) - d / length_scale)
