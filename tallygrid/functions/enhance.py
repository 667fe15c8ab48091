"""Standard wordings for terse descriptions, by trade, as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrid.functions.classify import any_of

DETAILED = 80
CODES = ("PNT-", "CL-", "GWB-", "HVAC-")
# Fixed values: (trade, words that must be there, words of which one must be, wording); the first that fits. {0} is the size in inches.
WORDINGS = (
    ("Painting", ("paint",), ("wall", "surface"), "Wall Paint: Mfg: Sherwin Williams, Type: Eggshell finish (2 coats)"),
    ("Painting", ("paint",), ("ceiling",), "Ceiling Paint: Mfg: Sherwin Williams, Color: Extra White, Type: Flat"),
    ("Painting", ("paint",), ("primer",), "Primer Coat: Mfg: Sherwin Williams, Type: Eggshell"),
    ("Painting", ("paint",), (), "Painting: Mfg: Sherwin Williams, Type: Eggshell finish"),
    ("Drywall", (), ("drywall", "gwb"), 'GWB-01: 5/8" Type X Gypsum Wallboard, install per GA-216, tape and finish all joints'),
    ("Ceilings", (), ("acoustic", "act"), "CL-03 (ACT): 2' x 2' Acoustical Ceiling Tile, light gray with medium border"),
    ("Ceilings", (), ("gypsum", "gwb"), 'CL-03 (GWB): 5/8" Gypsum Wallboard Ceiling, taped and finished'),
    ("HVAC", ("duct",), ('"',), '{0}" Dia Duct: Supply/Return, insulated, including hangers and supports'),
    ("HVAC", ("duct",), (), "Ductwork: Supply/Return, insulated, including all fittings and supports"),
    ("HVAC", ("diffuser",), (), "Supply Air Diffuser: Side tap, including volume damper"),
    ("HVAC", ("grille",), (), "Return Air Grille: With filter rack, wall/ceiling mounted"),
    ("Electrical", (), ("receptacle", "outlet"), "Duplex Receptacle: 20A, NEMA 5-20R, with cover plate"),
    ("Electrical", (), ("light", "fixture"), "Light Fixture: LED, recessed 2'x4', including lamps and trim"),
    ("Electrical", ("panel",), (), "Panel Board: 42 circuit, 225A main breaker, including labeling"),
    ("Electrical", ("switch",), (), "Wall Switch: Single pole, 15A, with cover plate"),
    ("Doors", (), (), 'Hollow Metal Door: 1-3/4" thick, 18 gauge, with knock-down frame, including hardware'),
    ("Flooring", ("carpet",), (), 'CPT: Carpet Tile, 24" x 24" modular, with adhesive and edge strip'),
    ("Flooring", (), ("vinyl", "lvt"), 'LVT: Luxury Vinyl Tile, 6" x 36" plank, with underlayment'),
    ("Flooring", ("tile",), (), 'VCT: Vinyl Composition Tile, 12" x 12" standard pattern, with adhesive'),
    ("Flooring", ("base",), (), 'B7: 7" Vinyl Wall Base, coved, with adhesive and corner pieces'),
    ("Plumbing", (), ("fixture", "sink"), "Plumbing Fixture: ADA compliant, including supply lines and P-trap"),
    ("Plumbing", (), (), "Plumbing: Rough-in, including insulation, floor cuts and patches"),
    ("Millwork", (), (), "Millwork: Custom cabinets, laminate countertop, adjustable shelves, including hardware"),
    ("Fire Protection", (), (), "Fire Protection: Sprinkler heads, including piping, hangers, and testing"),
    ("Demolition", (), (), "Demolition: Remove existing materials, dispose off-site, protect adjacent surfaces"),
)


def enhanced(description: Column, trade: Column) -> Column:
    """The standard wording of a description, or itself where it is long, has a code, or no wording fits."""
    low, size = F.lower(description), F.regexp_extract(description, '([0-9]+)"', 1)
    out = F.when((F.length(description) > DETAILED) | any_of(description, CODES), description)
    for name, every, some, wording in WORDINGS:
        fits = trade == name
        for w in every:
            fits = fits & F.contains(low, F.lit(w))
        if some == ('"',):
            fits = fits & (size != "")
        elif some:
            fits = fits & any_of(low, some)
        out = out.when(fits, F.replace(F.lit(wording), F.lit("{0}"), size))
    return out.otherwise(description)
