"""Plain second implementations of the item generators, for small texts: what the column expressions must give."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from tallygrid.functions import fixed
from tallygrid.operators.generators import _DIMS, FLOOR_PARTS, FLOOR_WORDS, FLOORS, MATS, NO_COLOR, NO_MAKER


def _firsts(found, key) -> list:
    """The first of those with the same key, in order."""
    out = {}
    for x in found:
        out.setdefault(key(x), x)
    return list(out.values())


@dataclass(frozen=True)
class Rule:
    """One rule of the context form.

    mode      each: an item a match; count: an item a distinct match, with its number as quantity; flag: one item if found;
              first: one item, for the first match
    describe  a format string of the match's groups ({0} the whole), or a function of (match, text); None or '' gives no item
    needs     sets of words: of each set, one must be in the text (any case)
    """

    trade: str
    unit: str | None
    confidence: float
    describe: str | Callable
    pattern: str = ""
    mode: str = "each"
    needs: tuple[tuple[str, ...], ...] = ()
    flags: int = re.IGNORECASE

    def items(self, text: str, upper: str) -> Iterator[tuple]:
        if not all(any(w in upper for w in words) for words in self.needs):
            return
        if not self.pattern:
            yield self.describe, self.trade, None, self.unit, self.confidence
            return
        found = (self.said(m, text) for m in re.finditer(self.pattern, text, self.flags))
        said = [d for d in found if d]
        if self.mode == "count":
            for d, n in Counter(said).items():
                yield d, self.trade, float(n), self.unit, self.confidence
            return
        for d in said[:1] if self.mode in ("flag", "first") else said:
            yield d, self.trade, None, self.unit, self.confidence

    def said(self, m: re.Match, text: str) -> str | None:
        if callable(self.describe):
            return self.describe(m, text)
        return self.describe.format(m.group(), *(g or "" for g in m.groups())).strip()


def items_of(text: str, rules: Sequence[Rule]) -> list[tuple]:
    """All items that the rules give for a text, rule by rule."""
    upper = text.upper()
    return [x for r in rules for x in r.items(text, upper)]


def around(m: re.Match, text: str, before: int, after: int) -> str:
    return text[max(0, m.start() - before) : m.end() + after]


def place(text: str, words: str) -> int:
    """Where words are first found in a text, whatever their case, or -1; an upper-cased copy of the text might be longer."""
    m = re.search(re.escape(words), text, re.IGNORECASE)
    return m.start() if m else -1


def number(s: str) -> int | None:
    digits = s.strip("\"'")
    return int(digits) if digits.isdigit() else None


def _between(low: int, high: int, template: str):
    """Describes a match whose groups are all sizes within bounds."""

    def say(m: re.Match, text: str) -> str | None:
        sizes = [number(g) for g in m.groups()]
        return template.format(m.group(), *m.groups()) if all(s is not None and low <= s <= high for s in sizes) else None

    return say


def _flag(trade: str, unit: str, confidence: float, name: str, *needs: tuple[str, ...]) -> Rule:
    return Rule(trade, unit, confidence, name, needs=needs)


# mechanical. Patterns, names, units, confidences.
DUCTS = (
    Rule("HVAC", "EA", 0.75, _between(2, 36, "{1} Dia Duct"), r'\b(\d+"?)\s*[\u00f8\u2205]\b', "count", flags=0),
    Rule("HVAC", "EA", 0.75, _between(2, 60, '{1}"x{2}" Duct'), r"\b(\d+[\"']?)\s*x\s*(\d+[\"']?)\b", "count", flags=0),
)
_SIZE = r"(\d/\d+\"|1\"|3/4\")"
REFRIGERANT = (
    Rule("HVAC", "FT", 0.7, "{1} Dia Refrigerant Lines", _SIZE + r"\s*(?:ø|∅)?\s*REFRIGERANT", "count"),
    Rule("HVAC", "FT", 0.7, "{1} Pipe upto Roof", _SIZE + r"\s*(?:ø|∅)?\s*PIPE\s+(?:UP\s+)?TO\s+ROOF", "count"),
    Rule("HVAC", "FT", 0.7, "{1} Condensate Line", _SIZE + r"\s*CONDENSATE", "count"),
)
REFRIGERANT_UNSIZED = Rule(
    "HVAC", "FT", 0.7, lambda m, t: (s.group() if (s := re.search(_SIZE, around(m, t, 200, 200))) else '1"') + " Dia Refrigerant Lines", r"REFRIGERANT\s+(?:SUCTION|LIQUID|GAS)"
)
DEMOLITION = (
    Rule("Demolition", "EA", 0.7, "Remove Existing {1}", r"REMOVE\s+EXISTING\s+([A-Z][A-Z\s]+)"),
    Rule("Demolition", "EA", 0.7, lambda m, t: f"Existing {m[1].strip()} to be Removed", r"EXISTING\s+([A-Z][A-Z\s]+)\s+TO\s+BE\s+REMOVED"),
    Rule("Demolition", "EA", 0.7, "Remove Section of {1}", r"REMOVE\s+SECTION\s+OF\s+([A-Z][A-Z\s]+)"),
)
FITTINGS = (
    Rule("HVAC", "EA", 0.8, '{1}" Flexible Duct to Diffuser', r'(\d+)"\s+Flexible\s+Duct\s+to\s+Diffuser'),
    Rule("HVAC", "EA", 0.8, '{1}" Flexible Duct to Diffuser', r'(\d+)"\s+FLEXIBLE\s+DUCTWORK'),
    Rule("HVAC", "EA", 0.7, lambda m, t: f"{m[1]} Dia Duct Elbow" if m[1] else f'{m[2]}"x{m[3]}" Duct Elbow', r"\b(\d+\"?)\s*(?:ø|∅)?\s*ELBOW|\b(\d+[\"']?)\s*x\s*(\d+[\"']?)\s*ELBOW"),
    _flag("HVAC", "EA", 0.7, "Clinch Collar w/ Clinch Lock", ("CLINCH",)),
    _flag("HVAC", "EA", 0.7, "Duct to Duct Connections", ("DUCT TO DUCT", "DUCT CONNECTION")),
    _flag("HVAC", "EA", 0.7, "Exterior Ductwork Support (5/M402)", ("EXTERIOR DUCTWORK SUPPORT",)),
    _flag("HVAC", "EA", 0.7, "Provide Pipe Curb throughout Roof", ("PIPE CURB", "PIPE PORTAL")),
    _flag("Plumbing", "EA", 0.7, "Cleanout", ("CLEANOUT",)),
)
EQUIPMENT_ROWS = (
    Rule("HVAC", "EA", 0.85, lambda m, t: f"RTU-{m[1]}: {m[4].strip()}, {m[3]} CFM, Area: {m[2].strip()}", r"RTU-(\d+)\s*\n([A-Z][A-Z\s/]+?)\s*\n.*?(\d[,\d]*)\s*\n.*?([A-Z][A-Z\s/-]+\s*/\s*[A-Z0-9-]+)", flags=re.DOTALL),
    Rule("HVAC", "EA", 0.8, lambda m, t: _pair(m, t, 1, "AC", "Outdoor"), r"AC-(\d+)\s*[/,\s]*HP-(\d+)"),
    Rule("HVAC", "EA", 0.8, lambda m, t: _pair(m, t, 2, "HP", "Indoor"), r"AC-(\d+)\s*[/,\s]*HP-(\d+)"),
    Rule("HVAC", "EA", 0.85, lambda m, t: f"EF-{m[1]}: {m[3]} / {m[4]}, {m[2]} CFM", r"EF-(\d+)\s*\n[^\n]*\n\s*(\d+)\s*\n(?:[^\n]*\n){0,8}?\s*([A-Z][A-Z ]+)\s*/\s*([A-Z0-9-]+)", flags=0),
    Rule("HVAC", "EA", 0.85, lambda m, t: f"CUH-{m[1]}: {m[2]} / {m[3]}", r"CUH-(\d+)\s*\n(?:[^\n]*\n){0,10}?\s*([A-Z][A-Z ]+)\s*/\s*([A-Z0-9-]+)", flags=0),
)
VAV_PLAIN = Rule("HVAC", "EA", 0.7, "VAV-{1}: Variable Air Volume Terminal Unit", r"VAV\s*(\d+)", "count")


def _pair(m: re.Match, text: str, group: int, kind: str, where: str) -> str | None:
    """An outdoor or indoor unit of a split system, if its maker and model stand near."""
    s = re.search(r"([A-Z][A-Z\s/-]+)\s*/\s*([A-Z0-9-]+)", text[m.end() : m.end() + 500])
    return f"{kind}-{m[group]}: B.O.D {where} Unit: {s[1].strip()} / {s[2]}" if s else None


# electrical. Patterns, names, units, confidences.
RECEPTACLES = (
    Rule("Electrical", "EA", 0.7, "GFCI Receptacle", r"GFCI\s+RECEPTACLE", "flag"),
    _flag("Electrical", "EA", 0.8, "Special Purpose Receptacle", ("SPECIAL PURPOSE RECEPTACLE",)),
    _flag("Electrical", "EA", 0.75, "Automatic Control Receptacle", ("RECEPTACLE CONTROLLED", "ROOM CONTROLLER")),
    _flag("Electrical", "EA", 0.75, "Ceiling Mounted Receptacle", ("CEILING MOUNT",), ("RECEPTACLE",)),
    _flag("Electrical", "EA", 0.75, "Quadruplex Receptacle", ("QUADRUPLEX",), ("RECEPTACLE",)),
    _flag("Electrical", "EA", 0.75, "USB Receptacle", ("USB",), ("RECEPTACLE",)),
)
LEGEND = (
    *(
        Rule("Electrical", "EA", 0.8, name, pattern, "flag")
        for pattern, name in (
            (r"SINGLE[-\s]*POLE\s*SWITCH", "Single Pole Switch"),
            (r"THREE[-\s]WAY\s+SWITCH", "Three Way Switch"),
            (r"DIMMER\s+SWITCH", "Dimmer Switch"),
            (r"VACANCY\s+SENSOR", "Vacancy Sensor"),
            (r"DAYLIGHT\s+SENSOR", "Daylight Sensor"),
            (r"OCCUPANCY\s+SENSOR", "Occupancy Sensor"),
            (r"AUTOMATIC\s+DOOR\s+OPENER", "Automatic Door Opener with Junction Box. Provide Power, coordinate with Door contractor"),
            (r"FIRE\s+ALARM\s+MANUAL\s+PULL\s+STATION", "Fire Alarm Manual Pull Station"),
            (r"FIRE\s+ALARM\s+DUCT\s+DETECTOR", "Fire Alarm Duct Detector. Provide with Remote Indicator Light Mounted in Ceiling."),
            (r"JUNCTION\s+BOX", "Junction Box"),
            (r"ROOM\s+CONTROLLER\s*\(LTG", "Light Control Panel"),
        )
    ),
    _flag("Electrical", "EA", 0.75, "Ceiling Mounted Data Outlet", ("DATA OUTLET",)),
    _flag("Electrical", "EA", 0.75, 'Door Access Card Reader, Provide Empty Single Gang Box and 3/4" Empty Conduit (w/ Pull String)', ("CARD READER", "DOOR ACCESS")),
    _flag("Electrical", "EA", 0.75, "Wall Mounted Fire Alarm", ("WALL MOUNTED",), ("FIRE ALARM",)),
    _flag("Electrical", "LF", 0.75, "Sawcut Existing Concrete Slab for Conduit Installation", ("SAWCUT",), ("CONDUIT",)),
    _flag("Electrical", "EA", 0.75, "Light and Power Wiring", ("LIGHT AND POWER WIRING",)),
)
WIRING = (
    Rule("Electrical", "EA", 0.75, "{1}A-{2}P Circuit Breaker", r"(\d+)\s*A\s*[-\s]\s*(\d+)\s*P\s+CIRCUIT\s+BREAKER"),
    Rule("Electrical", "EA", 0.75, "{1}kVA XFMR {2}-{3}", r"(\d+)\s*kVA\s+XFMR\s+(\d+V)[-\s]+(\d+V/?\d*V?)"),
    Rule("Electrical", "EA", 0.7, lambda m, t: f"{m[1].title()} {m[2]} to {m[3].title()} {m[4]} Wiring", r"(PANEL|TRANSFORMER)\s+([A-Z0-9]+)\s+(?:TO|FROM)\s+(PANEL|TRANSFORMER)\s+([A-Z0-9]+).*?WIRING"),
    Rule("Electrical", "EA", 0.75, "Panel {1} to New Breaker Wiring", r"PANEL\s+([A-Z0-9]+)\s+TO\s+NEW\s+BREAKER", "first"),
)
EMERGENCY = (
    _flag("Electrical", "EA", 0.75, "Emergency Battery Pack with Unit Mount Lighting Heads", ("EMERGENCY BATTERY PACK",)),
    _flag("Electrical", "EA", 0.75, "Emergency Lighting Remote Head", ("EMERGENCY",), ("REMOTE HEAD",)),
    _flag("Electrical", "EA", 0.75, "Undercounter Light", ("UNDERCOUNTER",), ("LIGHT",)),
)


def _panel(m: re.Match, text: str) -> str | None:
    tag = m[1].upper()
    known = any(w in tag for w in ("FEEDERS", "SCHEDULE", "SCHEDULES", "BOARD", "EXIST"))
    return f"Panel {m[1]}: {m[2]}A" if not known and 10 <= int(m[2]) <= 5000 else None


#: Off in the pipelines, as its matches reach too far.
PANELS = (Rule("Electrical", "EA", 0.7, _panel, r"PANEL\s+([A-Z0-9]+)\s*\n.*?(\d+)\s*A", flags=re.IGNORECASE | re.DOTALL),)


def _transformer(m: re.Match, text: str) -> str:
    near = around(m, text, 200, 300)
    if v := re.search(r"(\d+)\s*V\s*/\s*(\d+)\s*V", near):
        one, two = (v[2], v[1]) if (v[1], v[2]) == ("480", "277") else (v[1], v[2])
        return f"{m[1]}kVA XFMR {one}V-{two}V"
    if v := re.search(r"(\d+/\d+)V", near):
        return f"{m[1]}kVA XFMR {v[1]}V"
    return f"{m[1]}kVA XFMR 480V-208/120V" if "PANEL VP1" in near.upper() else f"{m[1]} kVA Transformer"


TRANSFORMERS = (Rule("Electrical", "EA", 0.7, _transformer, r"(\d+)\s*KVA\s*TRANSFORMER"),)


def nema_receptacles(text: str) -> list[tuple]:
    """One item for each kind of receptacle that the first NEMA mention names: plain, GFCI, and both."""
    found = list(re.finditer(r"(NEMA\s+\d+-\d+R)\s*(DUPLEX|DOUBLE)?\s*RECEPTACLE", text, re.IGNORECASE))
    if not found:
        return []
    ground = [any(w in around(m, text, 100, 100).upper() for w in ("GFCI", "GFI")) for m in found]
    name, kind = found[0][1].upper(), found[0][2] or ""
    said = [f"{name} {kind} Receptacle"] if not all(ground) else []
    said += [f"{name} GFCI Receptacle", f"{name} {kind} Receptacle with GFCI"] if any(ground) else []
    return [(d.strip(), "Electrical", None, "EA", 0.75) for d in said]


def _field(m: re.Match | None, template: str) -> str:
    return template.format(*m.groups()) if m else ""


def diffuser_rows(text: str) -> list[tuple]:
    """Diffusers: a tag line and up to 14 lines of fields until the next tag, told apart by form; later fields win."""
    heads = ("DIFFUSERS, REGISTERS AND GRILLES SCHEDULE", "AIR DEVICE SCHEDULE", "DIFFUSER SCHEDULE", "GRILLE SCHEDULE")
    at = next((i for h in heads if (i := text.find(h)) >= 0), -1)
    if at < 0:
        return []
    others = (
        "ELECTRIC TERMINAL UNIT HEATER SCHEDULE", "EXHAUST FAN SCHEDULE", "ROOFTOP AIR CONDITIONING UNIT SCHEDULE", "VAV TERMINAL UNIT SCHEDULE",
        "AIR HANDLING UNIT SCHEDULE", "UNIT HEATER SCHEDULE", "CHILLER SCHEDULE", "BOILER SCHEDULE",
    )
    end = min((i for o in others if (i := text.find(o, at + 1)) >= 0), default=len(text))
    forms = (("cfm", r"\d+\s*[-\u2013]\s*\d+"), ("module", r"\d+\s*x\s*\d+"), ("pattern", r"(?i:\d-WAY|GRID CORE|PERFORATED|LOUVERED)"), ("material", r"(?i:ALUMINUM|STEEL|GALVANIZED|STAINLESS)"), ("bod", r'\d+"?'))
    out, rows = [], []
    for line in map(str.strip, text[at:end].split("\n")):
        if re.fullmatch(r"[A-Z]{1,3}-\d+", line):
            rows.append((line, []))
        elif rows:
            rows[-1][1].append(line)
    for tag, fields in rows:
        got = {}
        for f in fields[:14]:
            if kind := next((k for k, p in forms if re.fullmatch(p, f)), None):
                got[kind] = f
        if "module" in got or "cfm" in got:
            said = [f"{tag}:"]
            said += [f"-B.O.D: {got['bod']}"] if "bod" in got else []
            if "module" in got:
                w, h = re.split(r"\s*x\s*", got["module"])
                said.append(f'-Nominal Module Size: {w}"x{h}"')
            said += [f"-CFM: {got['cfm'].replace(' ', '')}"] if "cfm" in got else []
            said.append(f"-Material: {got.get('material', 'Aluminum').title()}")
            out.append(("\n".join(said), "HVAC", None, "EA", 0.85))
    return out


def vav_schedule(text: str) -> list[tuple]:
    """The distinct VAV tags of 3000 characters after the heading, with the maker and model that they share."""
    at = place(text, "VAV TERMINAL UNIT SCHEDULE")
    if at < 0:
        return []
    part, maker, model = text[at : at + 3000], "Unknown", ""
    for p in (r"([A-Z]{2,5})\s*/\s*([A-Z0-9\-]{2,10})", r"MANUFACTURER[:\s]+([A-Z]{2,10}).*MODEL[:\s]+([A-Z0-9\-]{2,10})"):
        m = re.search(p, part)
        if m and m[1] not in ("IN", "NO", "MAX", "MIN", "CFM", "UNIT"):
            maker, model = m[1], m[2]
            break
    return [(f"VAV-{t}:\n-Mfg/Model: {maker}/{model}", "HVAC", None, "EA", 0.85) for t in sorted(set(re.findall(r"\bVAV-(\d+[A-Z]?)\b", part)))]


_LIGHT_TAGS = r"[A-Z]{1,3}-\d+|[A-Z]|\d+"
_PLACES = ("VESTIBULE", "HALLWAY", "PROCEDURE", "ROOM", "OFFICE", "CORRIDOR", "CHECK IN/OUT", "LOBBY", "WAITING", "RESTROOM", "BATHROOM", "TOILET", "BREAK")


def lighting_rows(text: str) -> list[tuple]:
    """Fixtures: a tag line, then fields; the description goes up to the first field in capitals, which is the maker, then the model."""
    out = []
    at = place(text, "LIGHTING FIXTURE SCHEDULE")
    rows: list[tuple[str, list[str]]] = []
    for line in map(str.strip, text[at : at + 4000].split("\n")) if at >= 0 else ():
        if re.fullmatch(_LIGHT_TAGS, line):
            rows.append((line, []))
        elif rows and line:
            rows[-1][1].append(line)
    for tag, fields in rows:
        if len(fields) < 2:
            continue
        k = next((i for i in range(1, len(fields)) if re.fullmatch(r"[A-Z][A-Z\s/&\-]+", fields[i])), len(fields))
        said = " ".join(fields[:k])
        if (len(said) <= 4 and said.isalpha()) or any(p in said.upper() for p in _PLACES):
            continue
        maker, model = (fields[k] if k < len(fields) else ""), (fields[k + 1] if k + 1 < len(fields) else "")
        end = f"\n-Mfg: {maker}\n-Model: {model}" if maker and model else ""
        out.append((f"Light {tag}: {said}{end}", "Electrical", None, "EA", 0.85))
        if any(w in " ".join(fields).upper() for w in ("HATCHED", "EMERGENCY", "BACKUP")):
            out.append((f"Light {tag} with Integrated Emergency Battery Backup: {said}{end}", "Electrical", None, "EA", 0.85))
    for m in re.finditer(r"(LITHONIA\s+[A-Z0-9-]+).*?(\d+/\d+V|INTEGRAL LED)", text, re.IGNORECASE | re.DOTALL):
        said = m.group().replace("\n", " ")
        out += [(said, "Electrical", None, "EA", 0.75), (f"{said}, Integral LED with Emergency Backup", "Electrical", None, "EA", 0.75)]
    return out


def mechanical(text: str) -> list[tuple]:
    vav = vav_schedule(text)
    cool = items_of(text, REFRIGERANT)
    if not any("Refrigerant" in x[0] for x in cool):
        cool = items_of(text, [REFRIGERANT_UNSIZED]) + cool
    units = vav + items_of(text, EQUIPMENT_ROWS) + ([] if vav else items_of(text, [VAV_PLAIN]))
    return items_of(text, DUCTS) + diffuser_rows(text) + units + cool + items_of(text, DEMOLITION) + items_of(text, FITTINGS)


def electrical(text: str) -> list[tuple]:
    return nema_receptacles(text) + items_of(text, RECEPTACLES) + lighting_rows(text) + items_of(text, LEGEND + WIRING + EMERGENCY + TRANSFORMERS)


# schedule rows


def valid_tag(tag: str) -> bool:
    tag = tag.strip()
    if len(tag) < 2 or any(re.match(p, tag, re.IGNORECASE) for p in fixed.NO_TAG) or re.match(r"^[A-Z]-\d{3}$", tag):
        return False
    upper = tag.upper()
    return any(upper.startswith(p.upper()) for p in fixed.TAG_PREFIXES) or bool(re.match(r"^[A-Z]{3,}[-_]?\d", tag, re.IGNORECASE))


def tag_of(text: str) -> str | None:
    """The first valid tag, known kinds first; a general one only among equipment words."""
    for p in fixed.TAG_PATTERNS:
        m = re.search(p, text, re.IGNORECASE)
        if m and valid_tag(m[1]):
            return m[1].strip()
    m = re.search(fixed.GENERIC_TAG, text)
    lower = text.lower()
    return m[1] if m and valid_tag(m[1]) and any(w in lower for w in fixed.TAG_CONTEXT) else None


def schedule_rows(section: str) -> list[dict]:
    """Rows of a schedule: a tag in a line or in the next four, with two or more of flow, size, voltage and maker."""
    lines, out = section.split("\n"), []
    for i, raw in enumerate(lines):
        line = raw.strip()
        if len(line) < 3 or any(w in line.lower() for w in fixed.TITLE_BLOCK):
            continue
        tag = tag_of(line) or tag_of("\n".join(lines[i : i + 5]))
        if not tag:
            continue
        row = {}
        if m := re.search(r"(\d{2,4})\s*(?:-\s*(\d{2,4}))?\s*CFM", line, re.IGNORECASE):
            row["CFM"] = f"{m[1]}-{m[2]}" if m[2] else m[1]
        if m := re.search(r"(\d+(?:\.\d+)?)\s*[xX×]\s*(\d+(?:\.\d+)?)", line):
            row["Size"] = f'{m[1]}"x{m[2]}"'
        if m := re.search(r"(\d{2,3})\s*V", line):
            row["Voltage"] = f"{m[1]}V"
        near = "\n".join(lines[max(0, i - 2) : i + 5]).upper()
        if brand := next((b for b in fixed.ROW_BRANDS if b.upper() in near), None):
            row["Mfg"] = brand
        if len(row) >= 2:
            out.append({"tag": tag, **row})
    return out


def row_description(row: dict) -> str:
    return " | ".join([row["tag"], *(f"{k}: {v}" for k, v in row.items() if k != "tag")])


# Sections of specifications.
SPEC_SECTIONS = tuple(
    Rule(trade, "EA", 0.65, name, pattern, "flag")
    for pattern, name, trade in (
        (r"233346.*Flexible\s+Ducts", "Flexible Duct to Diffuser", "HVAC"),
        (r"232300.*Refrigerant", "Refrigerant Lines", "HVAC"),
        (r"233113.*Metal\s+Ducts", "Ductwork", "HVAC"),
        (r"233300.*Air\s+Devices", "Air Devices", "HVAC"),
        (r"235100.*Breechings", "Breeching", "HVAC"),
        (r"235200.*Fuel\s+Burners", "Fuel Burner", "HVAC"),
        (r"235300.*Heat\s+Generation", "Heat Generation Equipment", "HVAC"),
        (r"221319.*Sanitary\s+Waste", "Sanitary Waste System", "Plumbing"),
        (r"224000.*Plumbing\s+Fixtures", "Plumbing Fixtures", "Plumbing"),
    )
)


def _millwork(m: re.Match, text: str) -> str:
    said = m.group()
    if size := re.search(r"(\d+'-\d+\"|\d+'-\d+)", around(m, text, 100, 200)):
        said += f", Size: {size[1]}"
    near = around(m, text, 300, 200)
    return said + (" (Supplied by Client, Installed by GC)" if "Supplied by Client" in near else " (Supplied by GC)" if "Supplied by GC" in near else "")


def _door(m: re.Match, text: str) -> str:
    near, said = around(m, text, 50, 500), [f"Door {m[1]}: {m[2].strip()}"]
    if s := re.search(r"Size:\s*(\d'+-\d+\"x\d'+-\d+)\"", near):
        said.append(f"-Size: {s[1]}")
    if s := re.search(r'(\d+)"\s*Wide\s*Metal\s*Frame', near, re.IGNORECASE):
        said.append(f'-{s[1]}" Wide Metal Frame')
    if s := re.search(r"Stanley.*?hinge.*?#([^\s]+)", near, re.IGNORECASE):
        said.append(f"-Stanley spring type hinge #{s[1]}")
    return "\n".join(said)


# Patterns of running text, for files without schedules.
GENERAL_TEXT = (
    *(Rule("Millwork", "EA", 0.7, _millwork, p) for p in (r"Hook\s+&\s+Bench\s+Panel", r"Cash\s+(?:Backwrap|Counter)", r"Reception\s+Desk", r"Vanity", r"Casework")),
    Rule("Flooring", "LF", 0.7, "{0}", r"(Vinyl|Tile|Carpet|Porcelain|Quarry)\s+to\s+(Vinyl|Tile|Carpet|Porcelain|Quarry)\s+Transition"),
    Rule("Doors", "EA", 0.7, _door, r"Door\s+(\d+):\s*([^\n]+)"),
    Rule("Drywall", "SF", 0.6, "{0}", r'(\d+/\d+)"\s*(?:Type\s*[A-Z])?\s*Gypsum\s*(?:Wallboard|Board)'),
    Rule("Ceilings", "SF", 0.6, "{0}", r'(\d+"\s*x\s*\d+)"\s*(?:Acoustical\s*Tile|ACT)'),
    Rule("Flooring", "SF", 0.6, "{0}", r"(VCT|LVT|Vinyl)\s*(?:Tile|Composition)"),
    Rule("Electrical", "EA", 0.6, "{0}", r"(\d+)\s*A\s*,\s*(\d+)\s*V"),
)

_UNITS = ("RTU", "AHU", "VAV", "EF", "SF", "UNIT HEATER", "AIR HANDLER")
# Items inferred from words of the whole project.
INFERRED = (
    _flag("Millwork", "EA", 0.45, "Millwork - Fitting Room (Supplied by Client, Installed by GC)", ("MILLWORK", "CABINET"), ("FITTING ROOM", "DRESSING ROOM")),
    _flag("Millwork", "EA", 0.45, "Millwork - Reception (Supplied by Client, Installed by GC)", ("MILLWORK", "CABINET"), ("RECEPTION", "FRONT DESK")),
    _flag("Millwork", "EA", 0.45, "Millwork - Storage (Supplied by Client, Installed by GC)", ("MILLWORK", "CABINET"), ("STOCK ROOM", "STORAGE")),
    _flag("Doors", "EA", 0.45, "Door Hardware and Accessories", ("DOOR SCHEDULE", "DOOR HARDWARE SET", "HARDWARE SET", "DOOR FRAME SCHEDULE")),
    _flag("HVAC", "EA", 0.45, "Flexible Ductwork to Diffusers", _UNITS, ("FLEXIBLE DUCT", "FLEX DUCT")),
    _flag("HVAC", "EA", 0.45, "Roof Equipment Curb", _UNITS, ("PIPE CURB", "ROOF CURB", "EQUIPMENT CURB")),
    _flag("Plumbing", "EA", 0.45, "Plumbing Cleanout", ("WATER CLOSET", "LAVATORY", "SINK", "FAUCET", "WATER HEATER", "SUMP PUMP"), ("CLEANOUT",)),
    _flag("HVAC", "LF", 0.45, "Refrigerant Lines", _UNITS, ("REFRIGERANT",)),
)


def inferred(text: str) -> list[tuple]:
    """What a project's whole text implies, and the items that every project has."""
    constant = [(d, t, 1.0, u, 0.7) for d, t, u in fixed.CONSTANT_ITEMS]
    return flooring(text) + transitions(text) + items_of(text, INFERRED) + constant


# callouts of the second context extractor. Patterns, names, units.
DEVICES = (
    (r"occupancy\s+sensor", "Occupancy Sensor"),
    (r"vacancy\s+sensor", "Vacancy Sensor"),
    (r"daylight\s+sensor", "Daylight Sensor"),
    (r"single\s+pole\s+switch", "Single Pole Switch"),
    (r"three\s+way\s+switch", "Three Way Switch"),
    (r"dimmer\s+switch", "Dimmer Switch"),
)
REMOVALS = (
    r"remove\s+existing\s+([\w\s]+?)(?:\.|,|;|$)",
    r"existing\s+([\w\s]+?)\s+to\s+be\s+removed",
    r"remove\s+section\s+of\s+([\w\s]+?)(?:\.|,|;|$)",
    r"remove\s+([\w\s]+?)\s+for\s+new\s+([\w\s]+?)(?:\.|,|;|$)",
)
MANAGEMENT = ((r"management\s+&?\s+supervision\s*\(?\s*(?:weeks?)?\s*\)?", "Weeks"), (r"documentation\s+&?\s+shop\s+drawings", "LS"), (r"project\s+management", "Weeks"), (r"site\s+supervision", "Weeks"))


def _application(near: str) -> str:
    return "Return" if "RET" in near else "Exhaust" if "EXHAUST" in near or "EF" in near else "Supply"


def ducts_v2(text: str) -> list[tuple]:
    """(size, duct_type, application, insulation) of each duct callout."""
    out = []
    for m in re.finditer(r'(\d+)"\s*[xX]\s*(\d+)"', text):
        near = around(m, text, 50, 50).upper()
        if "ELBOW" not in near:
            out.append((f'{m[1]}"x{m[2]}"', "Rectangular", _application(near), "Insulated" if "INSUL" in near else ""))
    for m in re.finditer(r'(\d+)"\s*(?:Dia\.?|DIA\.?|Diameter)\s*(?:Duct|DUCT)', text):
        near = around(m, text, 50, 50).upper()
        if "ELBOW" not in near:
            out.append((f'{m[1]}" Dia', "Round", _application(near), ""))
    out += [(f'{m[1]}" Dia', "Flexible", "Supply", "") for m in re.finditer(r'(\d+)"\s*(?:Flexible|FLEX)', text)]
    out += [(f'{m[1]}" Dia', "Elbow", "Supply", "") for m in re.finditer(r'(\d+)"\s*(?:Dia\.?|DIA\.?|Diameter)?\s*(?:Duct|DUCT)?\s*(?:Elbow|ELBOW)', text)]
    out += [(f'{m[1]}"x{m[2]}"', "Elbow", "Supply", "") for m in re.finditer(r'(\d+)"\s*[xX]\s*(\d+)"\s*(?:Duct|DUCT)?\s*(?:Elbow|ELBOW)', text)]
    return out


def duct_description(size: str, kind: str, application: str, insulation: str) -> str:
    if kind == "Elbow":
        return f"{size} Duct Elbow"
    if kind == "Flexible":
        return f"{size} Flexible Duct to Diffuser"
    return f"{size} Duct" + (f": {application}" if application != "Supply" else "") + (f", {insulation}" if insulation else "")


def callouts_v2(text: str) -> list[tuple]:
    """Ducts, devices, removals and management of a page as items, each distinct one once."""
    out = [(duct_description(*d), "HVAC", None, "EA", 0.9) for d in dict.fromkeys(ducts_v2(text))]
    out += [(name, "Electrical", None, "EA", 0.9) for p, name in DEVICES if re.search(p, text, re.IGNORECASE)]
    gone = [m.group().strip().replace("\n", " ") for p in REMOVALS for m in re.finditer(p, text, re.IGNORECASE)]
    out += [(d, "Demolition", None, "EA", 0.9) for d in _firsts(gone, str.lower)]
    run = [(m.group().strip().title(), u) for p, u in MANAGEMENT for m in re.finditer(p, text, re.IGNORECASE)]
    return out + [(d, "General", None, u, 0.9) for d, u in _firsts(run, lambda x: x[0].lower())]


# the second rule pipeline's line filters


def quantities(text: str, patterns=fixed.UNIT_PATTERNS) -> list[tuple[float, str]]:
    out = []
    for p, unit in patterns:
        for m in re.finditer(p, text, re.IGNORECASE):
            try:
                n = float(m[1].replace(",", "").replace(" ", ""))
            except ValueError:
                continue
            if n > 0:
                out.append((n, unit))
    return out


def present_trade(text: str) -> str:
    lower = text.lower()
    best, name = 0, "Other"
    for trade, words in fixed.TRADES_BY_PRESENCE:
        if (n := sum(w in lower for w in words)) > best:
            best, name = n, trade
    return name


def _line(line: str, most: int, confidence: float, trade: str | None = None) -> tuple:
    q = (quantities(line) or [(None, None)])[0]
    return line[:most], trade or present_trade(line), q[0], q[1], confidence


_ACTIONS = ("provide", "install", "furnish", "construct", "erect")
MATERIALS = (
    "fire extinguisher", "fire extinguisher cabinet", "bradley", "wood blocking", "blocking between studs", "ipc", "wall covering", "access panel", "smoke detector",
    "co2 sensor", "thermostat", "ceiling kit", "trim kit", "vibration isolation", "backdraft damper", "gravity damper", "switch", "sensor", "receptacle", "outlet", "conduit",
    "card reader", "door access", "occupancy sensor", "data outlet", "junction box", "lighting control", "fire alarm", "pull station", "duct detector", "diffuser", "grille",
    "register", "damper", "louver", "disconnect", "e-mon", "meter", "sawcut",
)


def drawing_lines(text: str) -> list[tuple]:
    lines, out = text.split("\n"), []
    for x in lines:
        if re.search(r"\b\d{3}[A-Z]?\b", x) and any(w in x.lower() for w in ("door", "frame", "hardware")):
            out.append(_line(x, 200, 0.6, "Doors"))
    for x in lines:
        low = x.lower()
        told = any(w in low for w in MATERIALS) or re.search(r"\(\d+\)|\d+\s*(EA|LF|SF|CF|RM|GAL|SET)", x, re.IGNORECASE) or re.search(fixed.EQUIPMENT_TAGS_V2.replace("|UV-1", ""), x, re.IGNORECASE)
        if 30 < len(x) < 300 and told and any(w in low for w in _ACTIONS):
            out.append(_line(x, 250, 0.55))
    return out


def scope_lines(text: str) -> list[tuple]:
    return [_line(x, 250, 0.6) for x in map(str.strip, text.split("\n")) if len(x) >= 20 and (re.match(r"^\d+\.|^[-•*]", x) or any(w in x.lower() for w in _ACTIONS[:3]))]


def generic_lines(text: str) -> list[tuple]:
    return [_line(x, 200, 0.5) for x in map(str.strip, text.split("\n")) if len(x) >= 20 and quantities(x)]


def plain_lines(text: str) -> list[tuple]:
    """The first rule extractor: lines of ten characters with a quantity, the first trade that has a keyword."""
    out = []
    for x in map(str.strip, text.split("\n")):
        if len(x) >= 10 and (q := quantities(x, fixed.UNIT_PATTERNS_V1)):
            low = x.lower()
            out.append((x[:200], next((t for t, ws in fixed.TRADES_BY_FIRST if any(w in low for w in ws)), "Other"), *q[0], 0.5))
    return out


WORK = (
    Rule("HVAC", "EA", 0.75, "{0}", r"PROVIDE\s+(WIRED\s+THERMOSTAT)"),
    Rule("HVAC", "EA", 0.75, "VAV Controls", r"VAV\s+CONTROLS"),
    Rule("Electrical", "EA", 0.75, "{0}", r"FIRE\s+ALARM\s+(CONTROL\s+PANEL|MANUAL\s+PULL)"),
)


def spec_lines(text: str) -> list[tuple]:
    heads = re.finditer(r"SECTION\s+(\d{6}(?:\.\d+)?)\s*[-–]\s*(.+?)(?:\s*PART\s*\d|\s*\d+\.\d|\Z)", text, re.IGNORECASE)
    return [(f"SECTION {m[1]}: {m[2].strip()}", present_trade(m[2]), None, None, 0.7) for m in heads] + items_of(text, WORK)


def lines_by_type(text: str, kind: str) -> list[tuple]:
    """The second pipeline's parser of a file, by its type; scope files reach theirs under either name."""
    parser = {"spec": spec_lines, "drawing": drawing_lines, "sow": scope_lines, "scope": scope_lines, "addendum": scope_lines}.get(kind, generic_lines)
    return parser(text)


def _dimension(near: str) -> str:
    """The longest dimension nearby, the first of equals."""
    found = []
    for k, p in enumerate(_DIMS):
        for m in re.finditer(p, near, re.IGNORECASE):
            d = m.group().strip()
            if (len(d) >= 5 and ("x" in d.lower() or "/" in d)) if k == 0 else len(d) > 5:
                found.append(d)
    return max(found, key=len, default="")


def _maker(near: str) -> str:
    m = re.search(r"(?:manufacturer|mfg)[:\s]+([A-Z][A-Za-z]{2,}(?:\s+[A-Z][A-Za-z]+){0,2})", near, re.IGNORECASE)
    if not m:
        return ""
    name = re.sub(r"^(?:SEE|NOT|AS|TO|BY|FOR|THE|AND|OR)\s+", "", re.sub(r"\s+\d+.*$", "", m[1].strip()), flags=re.IGNORECASE)
    return name if 2 < len(name) < 40 and not NO_MAKER & set(name.upper().split()) else ""


def _within(pattern: str, text: str, start: int, end: int | None):
    """The matches of a pattern that begin in a part of the text."""
    return (m for m in re.finditer(pattern, text, re.IGNORECASE) if start <= m.start() and (end is None or m.start() < end))


def floors(text: str, start: int = 0, end: int | None = None) -> list[tuple]:
    """Floors and their parts that begin between ``start`` and ``end``, and mats with a number, with what stands near them."""
    out = []
    for p, name, unit in FLOORS:
        for m in _within(p, text, start, end):
            near, shown = around(m, text, 200, 300), " ".join(w.capitalize() for w in m.group().strip().lower().split())
            shown = name if len(shown) <= 4 else shown if "flooring" in shown.lower() else f"{shown} Flooring"
            maker = _maker(near)
            said = [x for x in (_dimension(near), shown, f"Manufacturer: {maker}" if maker else "") if x]
            out.append((" | ".join(said), "Flooring", None, unit, 0.75))
    for p, name, unit in FLOOR_PARTS:
        for m in _within(p, text, start, end):
            near, said = around(m, text, 100, 100), [name]
            size = re.search(r"(\d+\s*(?:\d+/\d+)?\s*[\"'](?:\s*x\s*\d+\s*(?:\d+/\d+)?\s*[\"'])?)", near)
            if size and ("x" in size[1].lower() or "/" in size[1] or len(size[1].strip()) > 6):
                said.append(f"Size: {size[1].strip()}")
            color = re.search(r"(?:color|finish)[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})", near, re.IGNORECASE)
            if color and len(color[1]) < 30 and not NO_COLOR & set(color[1].lower().split()):
                said.append(f"Color: {color[1].strip()}")
            out.append((" | ".join(said), "Flooring", None, unit, 0.7))
    for p, name in MATS:
        numbered = (m for m in _within(p, text, start, end) if re.search(r"\d+\s*(?:ea|each|qty)", around(m, text, 100, 100), re.IGNORECASE))
        out += [(name, "Flooring", None, "EA", 0.5) for _ in numbered]
    return out


def flooring(text: str) -> list[tuple]:
    """Floors, their parts and mats of a whole text; a mat that is named twice needs no number. What they look at around a match is text that other matches share."""
    upper, out = text.upper(), floors(text)
    for p, name in MATS:
        if upper.count(name.upper()) >= 2:
            out = [x for x in out if x[0] != name] + [(name, "Flooring", None, "EA", 0.5) for _ in re.finditer(p, text, re.IGNORECASE)]
    return out


def transitions(text: str, start: int = 0, end: int | None = None) -> list[tuple]:
    """Pairs of floors whose names stand within 300 characters of a transition that begins between ``start`` and ``end``, spaces in names kept.

    A name that stands there is one of its own words, so the floor is in the text too.
    """
    near = [around(m, text, 300, 300).upper() for m in _within("TRANSITION", text, start, end)]
    names = [name for name, _ in FLOOR_WORDS]
    return [(f"{a} to {b} Transition", "Flooring", None, "FT", 0.45) for i, a in enumerate(names) for b in names[i + 1 :] if any(a.upper() in n and b.upper() in n for n in near)]
