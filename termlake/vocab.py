"""Controlled vocabularies.

The codes, labels, parents, strengths and word lists below are fixed values:
results have to agree on them.  Descriptions are explanatory only.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: concept types (code, label, parent), parents first
CONCEPT_TYPES: tuple[tuple[str, str, str | None], ...] = (
    ("CHEMICAL_ENTITY", "Chemical entity", None),
    ("ELEMENT", "Element", "CHEMICAL_ENTITY"),
    ("COMPOUND", "Compound", "CHEMICAL_ENTITY"),
    ("SALT", "Salt", "COMPOUND"),
    ("SOLVATE", "Solvate", "COMPOUND"),
    ("HYDRATE", "Hydrate", "SOLVATE"),
    ("POLYMER", "Polymer", "CHEMICAL_ENTITY"),
    ("CHEMICAL_CLASS", "Chemical class", "CHEMICAL_ENTITY"),
    ("FUNCTIONAL_GROUP", "Functional group", "CHEMICAL_ENTITY"),
    ("MARKUSH_CLASS", "Markush class", "CHEMICAL_ENTITY"),
    ("MATERIAL", "Material", None),
    ("MIXTURE_OR_COMPOSITION", "Mixture or composition", None),
    ("PROCESS", "Process", None),
    ("CHEMICAL_REACTION", "Chemical reaction", "PROCESS"),
    ("SYNTHESIS_PROCESS", "Synthesis process", "PROCESS"),
    ("SEPARATION_PROCESS", "Separation process", "PROCESS"),
    ("MANUFACTURING_PROCESS", "Manufacturing process", "PROCESS"),
    ("PROPERTY", "Property", None),
    ("CHEMICAL_PROPERTY", "Chemical property", "PROPERTY"),
    ("PHYSICAL_PROPERTY", "Physical property", "PROPERTY"),
    ("PERFORMANCE_PROPERTY", "Performance property", "PROPERTY"),
    ("MEASUREMENT", "Measurement", None),
    ("EQUIPMENT", "Equipment", None),
    ("APPLICATION", "Application", None),
    ("OTHER_TECHNICAL_CONCEPT", "Other technical concept", None),
)

# fixed values: other enumerations
CONTEXT_ROLES = (
    "STARTING_MATERIAL", "REACTANT", "REAGENT", "CATALYST", "SOLVENT", "INTERMEDIATE",
    "REACTION_PRODUCT", "ADDITIVE", "BINDER", "MATRIX", "COATING", "SUBSTRATE",
)
TEXT_UNIT_TYPES = ("title", "abstract", "claim", "paragraph", "description", "other")
TEXT_ORIGINS = ("original", "official_translation", "machine_translation", "unknown")
MAPPING_RELATIONS = ("EXACT_EQUIVALENT", "CONTEXTUAL_EQUIVALENT", "BROADER", "NARROWER", "RELATED", "NO_MATCH", "AMBIGUOUS")
TARGET_FORM_STATUSES = ("TRANSLATED", "UNCHANGED", "LANGUAGE_NEUTRAL", "NOT_PRESENT", "UNKNOWN")
RESOLUTION_OUTCOMES = ("SAME_CONCEPT", "NEW_CONCEPT", "RELATED_NOT_SAME", "AMBIGUOUS")
EXTERNAL_MAPPING_TYPES = ("EXACT", "CLOSE", "BROAD", "NARROW", "RELATED")
TERM_FORMS: tuple[tuple[str, str], ...] = (
    ("SYSTEMATIC_NAME", "Systematic name"),
    ("COMMON_NAME", "Common name"),
    ("TRIVIAL_NAME", "Trivial name"),
    ("TRADE_NAME", "Trade name"),
    ("ABBREVIATION", "Abbreviation"),
    ("ACRONYM", "Acronym"),
    ("MOLECULAR_FORMULA", "Molecular formula"),
    ("LINE_NOTATION", "Line notation"),
    ("REGISTRY_IDENTIFIER", "Registry identifier"),
    ("MULTIWORD_TECHNICAL_TERM", "Multi-word technical term"),
    ("PATENT_DEFINED_LABEL", "Patent-defined label"),
    ("SPELLING_VARIANT", "Spelling variant"),
    ("OTHER_TERM_FORM", "Other term form"),
)
RELATION_TYPES: tuple[tuple[str, str, bool], ...] = (
    ("BROADER_THAN", "Broader than", False),
    ("NARROWER_THAN", "Narrower than", False),
    ("RELATED_TO", "Related to", True),
    ("PART_OF", "Part of", False),
    ("SALT_OF", "Salt of", False),
    ("SOLVATE_OF", "Solvate of", False),
    ("HYDRATE_OF", "Hydrate of", False),
    ("ISOMER_OF", "Isomer of", True),
    ("STEREOISOMER_OF", "Stereoisomer of", True),
    ("POLYMER_OF", "Polymer of", False),
    ("DERIVATIVE_OF", "Derivative of", False),
    ("HAS_FUNCTIONAL_GROUP", "Has functional group", False),
)
IDENTIFIER_NAMESPACES: tuple[tuple[str, str, str], ...] = (
    ("CHEBI", "ChEBI ID", "authoritative"),
    ("PUBCHEM_CID", "PubChem CID", "strong"),
    ("INCHI", "InChI", "authoritative"),
    ("INCHIKEY", "InChIKey", "authoritative"),
    ("CANONICAL_SMILES", "Canonical SMILES", "strong"),
    ("ISOMERIC_SMILES", "Isomeric SMILES", "strong"),
    ("MOLECULAR_FORMULA", "Molecular formula", "supporting"),
    ("WIKIDATA", "Wikidata item", "supporting"),
    ("WIKIPEDIA_EN", "English Wikipedia page", "supporting"),
    ("IATE", "IATE entry", "supporting"),
    ("CAS_RN", "CAS Registry Number", "strong"),
)
STRENGTH_RANK = {"supporting": 1, "strong": 2, "authoritative": 3}
STRENGTH_WEIGHT = {"authoritative": 2.0, "strong": 1.5, "supporting": 0.35}

# what each type and namespace holds, for people and prompts
TYPE_DESCRIPTIONS: dict[str, str] = {
    "CHEMICAL_ENTITY": "Anything of definite chemical identity that no narrower type describes.",
    "ELEMENT": "One of the chemical elements, or atoms of it.",
    "COMPOUND": "A substance of one molecular or formula identity.",
    "SALT": "A compound of ions, told apart from its free acid or base.",
    "SOLVATE": "A compound that holds solvent in its crystal.",
    "HYDRATE": "A solvate whose solvent is water.",
    "POLYMER": "A substance of repeating units, by name or by monomer.",
    "CHEMICAL_CLASS": "A family of substances named by what they have in common.",
    "FUNCTIONAL_GROUP": "A part of a molecule that reacts as a whole.",
    "MARKUSH_CLASS": "A set of structures that a patent spans by variable groups.",
    "MATERIAL": "Matter named by its use or make-up and not by one identity.",
    "MIXTURE_OR_COMPOSITION": "Several substances put together on purpose.",
    "PROCESS": "A treatment of matter that no narrower process type describes.",
    "CHEMICAL_REACTION": "A change of substances into others.",
    "SYNTHESIS_PROCESS": "A way to make a wanted substance.",
    "SEPARATION_PROCESS": "A way to part, purify or recover substances.",
    "MANUFACTURING_PROCESS": "A way to shape or finish a material or a good made of it.",
    "PROPERTY": "A quality of matter that no narrower property type describes.",
    "CHEMICAL_PROPERTY": "A quality that shows in reactions.",
    "PHYSICAL_PROPERTY": "A quality that shows without a reaction.",
    "PERFORMANCE_PROPERTY": "How well a substance or material does its task.",
    "MEASUREMENT": "A quantity with its number and unit.",
    "EQUIPMENT": "Apparatus made for work with substances or materials.",
    "APPLICATION": "A purpose that needs the substance or material.",
    "OTHER_TECHNICAL_CONCEPT": "A concept of the field that no other type takes.",
}
NAMESPACE_DESCRIPTIONS: dict[str, str] = {
    "CHEBI": "Entry of the ontology of chemical entities of biological interest.",
    "PUBCHEM_CID": "Number of a compound record in PubChem.",
    "INCHI": "Standard structure string that tells layers of a compound apart.",
    "INCHIKEY": "Hash of 27 characters made of an InChI.",
    "CANONICAL_SMILES": "Line notation of the connections, without stereochemistry.",
    "ISOMERIC_SMILES": "Line notation with stereochemistry and isotopes.",
    "MOLECULAR_FORMULA": "Counts of atoms; many compounds share one.",
    "WIKIDATA": "Item of the open knowledge base.",
    "WIKIPEDIA_EN": "Page of the English encyclopedia.",
    "IATE": "Entry of the terminology base of the European Union.",
    "CAS_RN": "Registry number with a check digit; the registry is licensed.",
}

# what belongs to the terminology; the version is a fixed value
SCOPE_POLICY_VERSION = "1.0"
IN_SCOPE = (
    "Substances of any kind, their classes, structures, formulas, groups and polymers.",
    "Materials and mixtures that are defined by what they are made of or do chemically.",
    "Reactions, and processes that make, change, part or finish substances or materials.",
    "Properties, measurements, apparatus and uses whose chemical side is essential to them.",
)
OUT_OF_SCOPE = (
    "Words of patent drafting, and general terms of other trades.",
    "Apparatus that is only mentioned beside chemistry and not made for it.",
    "Goods and purposes whose name says nothing of substance or material.",
    "Vague words that mean something only in their sentence.",
)

# pairs that are never one concept, however alike their names are
NON_MERGE_RULES = (
    "A compound stays apart from its salts, solvates, hydrates and formulations.",
    "Isomers of any kind, isotopic variants and crystal forms stay apart.",
    "A class, also a Markush class, stays apart from its members.",
    "A pure substance stays apart from mixtures, compositions, materials and processes.",
    "A molecular formula may belong to several isomers, so it only supports an identity.",
    "Likeness of names or vectors finds candidates and proves nothing.",
    "Where the context leaves several meanings the answer is AMBIGUOUS and goes to review.",
)

# fixed values: chemical element symbols by atomic number
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr "
    "Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb "
    "Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()

# fixed values: phrase extraction (words that end a phrase to the left, head words by type, roles of heads)
BOUNDARY_WORDS = "a an and as at by comprising consisting for from in into of on or the to using with".split()
HEADS_BY_TYPE: dict[str, str] = {
    "MATERIAL": "additive adhesive alloy binder catalyst ceramic coating composite electrode electrolyte fiber film foam gel glass "
    "hydrogel layer material matrix membrane pigment polymer powder resin substrate",
    "CHEMICAL_CLASS": "monomer",
    "MIXTURE_OR_COMPOSITION": "blend composition dispersion emulsion formulation mixture solution suspension",
    "MANUFACTURING_PROCESS": "annealing calcination curing deposition drying",
    "SEPARATION_PROCESS": "crystallization distillation extraction filtration precipitation",
    "CHEMICAL_REACTION": "oxidation",
    "PROCESS": "conversion manufacturing polymerization process purification reaction recovery separation synthesis treatment",
    "PERFORMANCE_PROPERTY": "activity durability selectivity",
    "CHEMICAL_PROPERTY": "acidity alkalinity",
    "PHYSICAL_PROPERTY": "hardness permeability porosity solubility",
    "PROPERTY": "conductivity life resistance stability strength viscosity",
    "EQUIPMENT": "cell cells circuit diode plant reactor vessel",
    "APPLICATION": "restoration",
}
HEAD_TYPE = {w: t for t, words in HEADS_BY_TYPE.items() for w in words.split()}
HEAD_ROLE = {"additive": "ADDITIVE", "binder": "BINDER", "catalyst": "CATALYST", "coating": "COATING", "matrix": "MATRIX", "substrate": "SUBSTRATE"}

# fixed values: labels of the reaction-text model and their types and roles
REACTION_LABEL_TYPE = {
    "STARTING_MATERIAL": "CHEMICAL_ENTITY", "REAGENT_CATALYST": "CHEMICAL_ENTITY", "REACTION_PRODUCT": "CHEMICAL_ENTITY",
    "SOLVENT": "CHEMICAL_ENTITY", "OTHER_COMPOUND": "CHEMICAL_ENTITY", "TEMPERATURE": "MEASUREMENT", "TIME": "MEASUREMENT",
    "YIELD_PERCENT": "MEASUREMENT", "YIELD_OTHER": "MEASUREMENT", "EXAMPLE_LABEL": "OTHER_TECHNICAL_CONCEPT",
}
REACTION_LABEL_ROLE = {"STARTING_MATERIAL": "STARTING_MATERIAL", "REAGENT_CATALYST": "REAGENT", "REACTION_PRODUCT": "REACTION_PRODUCT", "SOLVENT": "SOLVENT"}

# fixed values: words by which authority descriptions are scored, types that have compound records
CHEMISTRY_WORDS = (
    "alloy carbohydrate chemical chemistry coating compound electrochemical element material metal molecule polymer polysaccharide protein reaction substance"
).split()
NON_DOMAIN_WORDS = ("album", "article", "family name", "film", "given name", "journal", "music", "surname", "video game")
COMPOUND_TYPES = ("CHEMICAL_ENTITY", "ELEMENT", "COMPOUND", "SALT", "SOLVATE", "HYDRATE")

_PARENT = {code: parent for code, _, parent in CONCEPT_TYPES}


def ancestors(code: str) -> list[str]:
    """The types above a type, nearest first."""
    out = []
    while (code := _PARENT[code]) is not None:
        out.append(code)
    return out


def root(code: str) -> str:
    return [code, *ancestors(code)][-1]


def map_column(values: dict) -> Column:
    """A literal map of a bounded vocabulary."""
    cell = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, (list, tuple)) else F.lit(v)
    return F.create_map(*chain.from_iterable((F.lit(k), cell(v)) for k, v in values.items()))


def ancestor_map() -> Column:
    return map_column({c: ancestors(c) for c in _PARENT})


def root_map() -> Column:
    return map_column({c: root(c) for c in _PARENT})


def render_types() -> str:
    """The types as lines for a prompt."""
    return "\n".join(f"- {code}: {label}" + (f" (a kind of {parent})" if parent else "") + f". {TYPE_DESCRIPTIONS[code]}" for code, label, parent in CONCEPT_TYPES)


def render_scope() -> str:
    """The scope policy as lines for a prompt."""
    return "\n".join([f"Scope {SCOPE_POLICY_VERSION}. Include:", *(f"- {x}" for x in IN_SCOPE), "Exclude:", *(f"- {x}" for x in OUT_OF_SCOPE)])
