"""Phrases of plans and specifications with the items that the takeoff's parsers must find in them, derived by hand.

Each entry is a page's text and its items ``(description, trade, quantity, unit, confidence)`` in order. ``{a}``, ``{b}`` and ``{c}`` stand for
numbers that differ from page to page: 1 to 50, 10 to 99, 10 to 34; a quantity of ``"a"`` is the first of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrid.operators import generators, parsers, rules

Item = tuple[str, str, "float | str | None", "str | None", float]
Book = list[tuple[str, list[Item]]]


Items = Callable[[Column, Column], Column]


def by_rules(table) -> Items:
    return lambda text, upper: rules.items_of(text, upper, table)


def _plain(parse: Callable[[str], list[tuple]]) -> Callable[[str], list[tuple]]:
    """Marks a parser that is a function of a plain text."""
    parse.plain = True
    return parse


def _flat(text: Column, upper: Column) -> Column:
    return F.transform(generators.schedule_rows(text), lambda d: rules.item(d, "Row", None, "EA", 1.0))


@_plain
def _two_pass(text: str) -> list[tuple]:
    return [("|".join(r), "Equipment", None, "EA", 1.0) for r in parsers.equipment_rows(text)]


@_plain
def _tags_v2(text: str) -> list[tuple]:
    return [("|".join(r), "Equipment", None, "EA", 1.0) for r in parsers.equipment_rows_v2(text)]


def _tag(text: Column, upper: Column) -> Column:
    tag = generators.tag_of(text)
    return F.when(tag.isNotNull(), F.array(rules.item(tag, "Tag", None, None, 1.0))).otherwise(rules.no_items())


def _valid(text: Column, upper: Column) -> Column:
    return F.array(rules.item(text, F.when(generators.valid_tag(text), "True").otherwise("False"), None, None, 1.0))


def _hvac(d: str, confidence: float, quantity: float | None = None, unit: str = "EA") -> Item:
    return d, "HVAC", quantity, unit, confidence


def _power(d: str, confidence: float, unit: str = "EA") -> Item:
    return d, "Electrical", None, unit, confidence


def _floor(d: str, unit: str, confidence: float) -> Item:
    return d, "Flooring", None, unit, confidence


NOTHING = ("Plain remarks without work.", [])

BOOKS: dict[str, tuple[Items | Callable[[str], list[tuple]], Book]] = {
    "gen_ducts": (
        by_rules(generators.DUCTS),
        [
            ('12"ø main, 12"ø branch and 8"ø tap', [_hvac('12" Dia Duct', 0.75, 2.0), _hvac('8" Dia Duct', 0.75, 1.0)]),
            ("Run {c}x14 and {c}x14 over corridor", [_hvac('{c}"x14" Duct', 0.75, 2.0)]),
            ("{c}ø riser", [_hvac("{c} Dia Duct", 0.75, 1.0)]),
            ('48"ø is too wide, and so is 72x80', []),
            NOTHING,
        ],
    ),
    "gen_refrigerant": (
        by_rules(generators.REFRIGERANT),
        [
            ('3/8" REFRIGERANT line and 7/8" PIPE UP TO ROOF', [_hvac('3/8" Dia Refrigerant Lines', 0.7, 1.0, "FT"), _hvac('7/8" Pipe upto Roof', 0.7, 1.0, "FT")]),
            ('3/4" CONDENSATE drain, 3/4" condensate riser {a}', [_hvac('3/4" Condensate Line', 0.7, 2.0, "FT")]),
            ("REFRIGERANT without a size", []),
            NOTHING,
        ],
    ),
    "gen_demolition": (
        by_rules(generators.DEMOLITION),
        [
            ("REMOVE EXISTING DUCT WORK.", [("Remove Existing DUCT WORK", "Demolition", None, "EA", 0.7)]),
            ("Existing sump pump to be removed;", [("Existing sump pump to be Removed", "Demolition", None, "EA", 0.7)]),
            ("Remove section of wall, {a} feet", [("Remove Section of wall", "Demolition", None, "EA", 0.7)]),
            NOTHING,
        ],
    ),
    "gen_fittings": (
        by_rules(generators.FITTINGS),
        [
            ('{c}" Flexible Duct to Diffuser', [_hvac('{c}" Flexible Duct to Diffuser', 0.8)]),
            ('{c}" FLEXIBLE DUCTWORK, clinch lock', [_hvac('{c}" Flexible Duct to Diffuser', 0.8), _hvac("Clinch Collar w/ Clinch Lock", 0.7)]),
            ('{c}" elbow', [_hvac('{c}" Dia Duct Elbow', 0.7)]),
            ("Cleanout at grade by pipe portal", [_hvac("Provide Pipe Curb throughout Roof", 0.7), ("Cleanout", "Plumbing", None, "EA", 0.7)]),
            NOTHING,
        ],
    ),
    "gen_equipment_rows": (
        by_rules(generators.EQUIPMENT_ROWS),
        [
            ("RTU-{a}\nSALES AREA\n1,200\nCARRIER / 48TC", [_hvac("RTU-{a}: CARRIER / 48TC, 1,200 CFM, Area: SALES AREA", 0.85)]),
            ("EF-{a}\nRESTROOM\n450\nCOOK / GC-120", [_hvac("EF-{a}: COOK  / GC-120, 450 CFM", 0.85)]),
            ("CUH-{a}\nSTAIR\nMARKEL / F334", [_hvac("CUH-{a}: MARKEL  / F334", 0.85)]),
            ("AC-{a}/HP-{a} on roof\nDAIKIN / FTX12", [_hvac("AC-{a}: B.O.D Outdoor Unit: DAIKIN / FTX12", 0.8), _hvac("HP-{a}: B.O.D Indoor Unit: DAIKIN / FTX12", 0.8)]),
            ("AC-{a}/HP-{a} on roof", []),
        ],
    ),
    "gen_vav_fallback": (by_rules([generators.VAV_PLAIN]), [("VAV {a} beside VAV {a}", [_hvac("VAV-{a}: Variable Air Volume Terminal Unit", 0.7, 2.0)]), NOTHING]),
    "gen_nema": (
        generators.nema_receptacles,
        [
            ("NEMA 5-20R DUPLEX RECEPTACLE in room {a}", [_power("NEMA 5-20R DUPLEX Receptacle", 0.75)]),
            ("NEMA 5-20R DUPLEX RECEPTACLE, GFCI at sink", [_power("NEMA 5-20R GFCI Receptacle", 0.75), _power("NEMA 5-20R DUPLEX Receptacle with GFCI", 0.75)]),
            ("RECEPTACLE of no kind", []),
        ],
    ),
    "gen_receptacles": (
        by_rules(generators.RECEPTACLES),
        [
            ("gfci receptacle {a}, GFCI RECEPTACLE {b}", [_power("GFCI Receptacle", 0.7)]),
            ("Special purpose receptacle", [_power("Special Purpose Receptacle", 0.8)]),
            ("Quadruplex floor receptacle with USB", [_power("Quadruplex Receptacle", 0.75), _power("USB Receptacle", 0.75)]),
            ("Ceiling mounted receptacle", [_power("Ceiling Mounted Receptacle", 0.75)]),
            ("A USB stick", []),
        ],
    ),
    "gen_elec_legend": (
        by_rules(generators.LEGEND),
        [
            ("SINGLE-POLE SWITCH, dimmer switch", [_power("Single Pole Switch", 0.8), _power("Dimmer Switch", 0.8)]),
            ("Vacancy  sensor and daylight sensor, junction box", [_power("Vacancy Sensor", 0.8), _power("Daylight Sensor", 0.8), _power("Junction Box", 0.8)]),
            ("Card reader {a}", [_power('Door Access Card Reader, Provide Empty Single Gang Box and 3/4" Empty Conduit (w/ Pull String)', 0.75)]),
            ("Wall mounted horn, fire alarm", [_power("Wall Mounted Fire Alarm", 0.75)]),
            ("Sawcut slab for conduit", [_power("Sawcut Existing Concrete Slab for Conduit Installation", 0.75, "LF")]),
            NOTHING,
        ],
    ),
    "gen_wiring": (
        by_rules(generators.WIRING),
        [
            ("{a}A-2P CIRCUIT BREAKER", [_power("{a}A-2P Circuit Breaker", 0.75)]),
            ("{b} kVA XFMR 480V-277V", [_power("{b}kVA XFMR 480V-277V", 0.75)]),
            ("PANEL LP{a} TO PANEL HP2 FEEDER WIRING", [_power("Panel LP{a} to Panel HP2 Wiring", 0.7)]),
            ("Panel LP{a} to new breaker, PANEL LP9 TO NEW BREAKER", [_power("Panel LP{a} to New Breaker Wiring", 0.75)]),
            NOTHING,
        ],
    ),
    "gen_emergency": (
        by_rules(generators.EMERGENCY),
        [
            ("Emergency battery pack", [_power("Emergency Battery Pack with Unit Mount Lighting Heads", 0.75)]),
            ("Emergency remote head {a}", [_power("Emergency Lighting Remote Head", 0.75)]),
            ("Undercounter light", [_power("Undercounter Light", 0.75)]),
            ("Remote head", []),
        ],
    ),
    "gen_panels": (
        by_rules(generators.PANELS),
        [("PANEL LP{a}\nmain 225 A", [_power("Panel LP{a}: 225A", 0.7)]), ("PANEL SCHEDULE\n225 A", []), ("PANEL LP{a}\nmain 6000 A", []), NOTHING],
    ),
    "gen_transformers": (
        by_rules(generators.TRANSFORMERS),
        [
            ("{b} KVA TRANSFORMER 480 V / 277 V", [_power("{b}kVA XFMR 277V-480V", 0.7)]),
            ("{b} KVA TRANSFORMER 208/120V", [_power("{b}kVA XFMR 208/120V", 0.7)]),
            ("{b} kva transformer in PANEL VP1", [_power("{b}kVA XFMR 480V-208/120V", 0.7)]),
            ("{b} KVA TRANSFORMER", [_power("{b} kVA Transformer", 0.7)]),
        ],
    ),
    "gen_flooring_types": (
        generators.flooring,
        [
            ("Porcelain tile at entry {a}", [_floor("Porcelain Tile Flooring", "SF", 0.75)]),
            ("engineered hardwood", [_floor("Engineered Hardwood Flooring", "SF", 0.75)]),
            ("Carpet tile, Manufacturer: Shaw Contract", [_floor("Carpet Tile Flooring | Manufacturer: Shaw Contract", "SF", 0.75)]),
            ('12" X 12" X 1/8" VINYL COMPOSITION TILE', [_floor('12" X 12" X 1/8" | Vinyl Composition Tile Flooring', "SF", 0.75)]),
            NOTHING,
        ],
    ),
    "gen_flooring_accessories": (
        generators.flooring,
        [
            ("Rubber base, color: Black", [_floor("Rubber Base | Color: Black", "LF", 0.7)]),
            ("Schluter edge trim", [_floor("Schluter Edge Trim", "LF", 0.7)]),
            ("Floor transition at door {a}", [_floor("Floor Transition", "LF", 0.7)]),
            ("Quarter round, color: see plan", [_floor("Quarter Round", "LF", 0.7)]),
            NOTHING,
        ],
    ),
    "gen_mats": (generators.flooring, [("Walk-off mat, 2 EA", [_floor("Walk-Off Mat", "EA", 0.5)]), ("Logo mat", []), ("Logo mat {a} each", [_floor("Logo Mat", "EA", 0.5)])]),
    "gen_transitions": (
        generators.transitions,
        [
            ("PORCELAIN TILE TO CARPET TRANSITION", [_floor("Porcelain Tile to Carpet Transition", "FT", 0.45)]),
            ("Quarry tile to vinyl transition", [_floor("Quarry Tile to Vinyl Transition", "FT", 0.45)]),
            ("Carpet and vinyl without a change", []),
        ],
    ),
    "gen_inferred": (
        by_rules(generators.INFERRED),
        [
            ("Millwork of the fitting room", [("Millwork - Fitting Room (Supplied by Client, Installed by GC)", "Millwork", None, "EA", 0.45)]),
            ("Door schedule {a}", [("Door Hardware and Accessories", "Doors", None, "EA", 0.45)]),
            ("RTU with flex duct and roof curb", [_hvac("Flexible Ductwork to Diffusers", 0.45), _hvac("Roof Equipment Curb", 0.45)]),
            ("Cleanout below lavatory", [("Plumbing Cleanout", "Plumbing", None, "EA", 0.45)]),
            ("RTU with refrigerant", [_hvac("Refrigerant Lines", 0.45, None, "LF")]),
            NOTHING,
        ],
    ),
    "gen_constants": (generators.constants, [("Nothing else {a}", [("Management & Supervision", "General", 1.0, "EA", 0.7), ("Documentation & Shop Drawings", "General", 1.0, "LS", 0.7)])]),
    "gen_spec_sections": (
        by_rules(generators.SPEC_SECTIONS),
        [
            ("233113 - Metal Ducts", [_hvac("Ductwork", 0.65)]),
            ("224000 of Plumbing Fixtures", [("Plumbing Fixtures", "Plumbing", None, "EA", 0.65)]),
            ("233346 Flexible Ducts, 235100 Breechings {a}", [_hvac("Flexible Duct to Diffuser", 0.65), _hvac("Breeching", 0.65)]),
            ("233114 Metal Ducts", []),
        ],
    ),
    "gen_general_text": (
        by_rules(generators.GENERAL_TEXT),
        [
            ("Reception Desk", [("Reception Desk", "Millwork", None, "EA", 0.7)]),
            ("Vinyl to Carpet Transition", [_floor("Vinyl to Carpet Transition", "LF", 0.7)]),
            ("Door 1{b}: Hollow Metal", [("Door 1{b}: Hollow Metal", "Doors", None, "EA", 0.7)]),
            ('5/8" Gypsum Board', [('5/8" Gypsum Board', "Drywall", None, "SF", 0.6)]),
            ('24" x 24" ACT', [('24" x 24" ACT', "Ceilings", None, "SF", 0.6)]),
            ("{b}A, 120V", [_power("{b}A, 120V", 0.6)]),
            NOTHING,
        ],
    ),
    "v2_ducts": (
        generators.callouts_v2,
        [
            ('{c}"x10" run, insulated', [_hvac('{c}"x10" Duct, Insulated', 0.9)]),
            ('{c}"x10" for return air', [_hvac('{c}"x10" Duct: Return', 0.9)]),
            ('{c}" Dia Duct, {c}" Dia Duct', [_hvac('{c}" Dia Duct', 0.9)]),
            ('{c}" Flexible', [_hvac('{c}" Dia Flexible Duct to Diffuser', 0.9)]),
            ('{c}" Dia Duct Elbow', [_hvac('{c}" Dia Duct Elbow', 0.9)]),
            NOTHING,
        ],
    ),
    "v2_devices": (
        generators.callouts_v2,
        [("Dimmer switch, occupancy  sensor", [_power("Occupancy Sensor", 0.9), _power("Dimmer Switch", 0.9)]), ("single pole switch {a}", [_power("Single Pole Switch", 0.9)]), ("a switch", [])],
    ),
    "v2_removes": (
        generators.callouts_v2,
        [
            ("Remove existing carpet tile. remove existing CARPET TILE.", [("Remove existing carpet tile.", "Demolition", None, "EA", 0.9)]),
            ("Existing sink to be removed, {a}", [("Existing sink to be removed", "Demolition", None, "EA", 0.9)]),
            NOTHING,
        ],
    ),
    "v2_management": (
        generators.callouts_v2,
        [("project management", [("Project Management", "General", None, "Weeks", 0.9)]), ("Site supervision {a}", [("Site Supervision", "General", None, "Weeks", 0.9)]), NOTHING],
    ),
    "rule2_specs": (
        generators.spec_lines,
        [
            ("SECTION 096500 - Resilient Flooring PART 1", [("SECTION 096500: Resilient Flooring", "Flooring", None, None, 0.7)]),
            ("Provide wired thermostat", [_hvac("Provide wired thermostat", 0.75)]),
            ("vav  controls", [_hvac("VAV Controls", 0.75)]),
            NOTHING,
        ],
    ),
    "rule2_scope": (
        generators.scope_lines,
        [
            ("1. Provide and install new carpet tile 12 EA", [("1. Provide and install new carpet tile 12 EA", "Flooring", 12.0, "EA", 0.6)]),
            ("Furnish {a} EA doors of oak", [("Furnish {a} EA doors of oak", "Doors", "a", "EA", 0.6)]),
            ("Provide it", []),
            ("Words about nothing to be done", []),
        ],
    ),
    "rule2_generic": (generators.generic_lines, [("Quarry stone pavers, {a} SF at lobby", [("Quarry stone pavers, {a} SF at lobby", "Other", "a", "SF", 0.5)]), ("Quarry stone pavers at lobby", [])]),
    "rule2_drawings": (
        generators.lines_by_type("drawing"),
        [
            ("Door 1{b}A hollow metal", [("Door 1{b}A hollow metal", "Doors", None, None, 0.6)]),
            ("Provide new access panel above ceiling", [("Provide new access panel above ceiling", "Ceilings", None, None, 0.55)]),
            ("Provide access panel", []),
            NOTHING,
        ],
    ),
    "rule1_lines": (generators.plain_lines, [("Carpet by the lift {a} SF", [("Carpet by the lift {a} SF", "Flooring", "a", "SF", 0.5)]), ("{a} SF", []), ("Carpet by the lift", [])]),
    "diffuser_rows": (
        generators.diffuser_rows,
        [
            ("DIFFUSER SCHEDULE\nS-{a}\n24 x 24\n95 - 210\nSTEEL", [_hvac('S-{a}:\n-Nominal Module Size: 24"x24"\n-CFM: 95-210\n-Material: Steel', 0.85)]),
            ("GRILLE SCHEDULE\nR-{a}\n100 - 200\nE-1\nnothing", [_hvac("R-{a}:\n-CFM: 100-200\n-Material: Aluminum", 0.85)]),
            ("S-{a}\n24 x 24", []),
        ],
    ),
    "lighting_rows": (
        generators.lighting_rows,
        [
            ("LIGHTING FIXTURE SCHEDULE\nA\nLED troffer {a}\nACME LIGHTING\nTX9000", [_power("Light A: LED troffer {a}\n-Mfg: ACME LIGHTING\n-Model: TX9000", 0.85)]),
            (
                "LIGHTING FIXTURE SCHEDULE\nB\nexit sign\nbackup",
                [_power("Light B: exit sign backup", 0.85), _power("Light B with Integrated Emergency Battery Backup: exit sign backup", 0.85)],
            ),
            ("LIGHTING FIXTURE SCHEDULE\nC\nlobby pendant\nACME", []),
        ],
    ),
    "vav_list": (
        generators.vav_schedule,
        [
            ("VAV TERMINAL UNIT SCHEDULE\nVAV-{a}\nTITUS / DESV\nVAV-{a}", [_hvac("VAV-{a}:\n-Mfg/Model: TITUS/DESV", 0.85)]),
            ("VAV TERMINAL UNIT SCHEDULE\nVAV-{a}", [_hvac("VAV-{a}:\n-Mfg/Model: Unknown/", 0.85)]),
            ("VAV-{a}", []),
        ],
    ),
    "schedule_rows": (
        _flat,
        [
            ("RTU-{a} 480V 900 CFM", [("RTU-{a} | CFM: 900 | Voltage: 480V", "Row", None, "EA", 1.0)]),
            ("AHU-{a} 24x12 CARRIER", [('AHU-{a} | Size: 24"x12" | Mfg: Carrier', "Row", None, "EA", 1.0)]),
            ("RTU-{a} 480V", []),
            ("Drawn by RTU-{a} 480V 900 CFM", []),
        ],
    ),
    "tag_extract": (
        _tag,
        [("see RTU-{a} there", [("RTU-{a}", "Tag", None, None, 1.0)]), ("ABC-{a} unit", [("ABC-{a}", "Tag", None, None, 1.0)]), ("ABC-{a} there", []), ("A-101 plan", [])],
    ),
    "tag_valid": (
        _valid,
        [(t, [(t, ok, None, None, 1.0)]) for t, ok in (("RTU-{a}", "True"), ("A-101", "False"), ("{b}", "False"), ("SHEET", "False"), ("QRS{a}", "True"), ("x", "False"))],
    ),
    "equipment_two_pass": (
        _two_pass,
        [
            ("EQUIPMENT SCHEDULE\nQQ-{a} MODEL AB1 CFM 900 VOLTAGE 480\n", [("QQ-{a}|QQ Equipment|Local Source|AB1", "Equipment", None, "EA", 1.0)]),
            ("FAN SCHEDULE\nEF-{a} MODEL X9 AMP 5 SCHLUTER", [("EF-{a}|Exhaust Fan|Schluter|X9", "Equipment", None, "EA", 1.0)]),
            ("EF-{a} MODEL X9 AMP 5", []),
        ],
    ),
    "equipment_v2": (
        _tags_v2,
        [
            ("VAV-{a} 450 CFM MODEL TBD", [("VAV-{a}|VAV Unit|Local Source||450 CFM", "Equipment", None, "EA", 1.0)]),
            ("S-{a} DIFFUSER 24x24", [("S-{a}|Supply Diffuser|Local Source||", "Equipment", None, "EA", 1.0)]),
            ("S-{a} sheet", []),
        ],
    ),
}

#: Texts with quantities, and (quantity, unit) pairs in the order of the units' patterns.
QUANTITIES = [
    ("Install 1,200 SF tile and {a} EA frames", [(1200.0, "SF"), ("a", "EA")]),
    ("{a} L.F. of base, 3 each", [("a", "LF"), (3.0, "EA")]),
    ("0 SF and no more", []),
    ("{a} FT", [("a", "FT")]),
]

