"""Patterns of descriptions that are no items, as text in their natural order."""

from __future__ import annotations

# Patterns of the default pipeline.
FALSE_POSITIVES = (
    r"^i\.\s+\$\d+",
    r"^\d+\.\s+(SEE|COORDINATE|PROVIDE|INSTALL|CONTRACTOR|MAINTAIN|ANY\s+ITEM|THE\s+CONTRACTOR|WHERE\s+DUCTS|OBTAIN\s+AND|FURNISH\s+ALL|SEQUENCE\s+OF|COORIDNATE\s+WORK|SUPPLAMENTARY\s+PRINTS|MATERIAL\s+EFFECT|REHABILITATION|ON\s+THE\s+PRINTS|HIS/HER\s+CONTRACT|THEREWITH)",
    r"^SECTION\s+\d+",
    r"^FOR DOOR",
    r"PROVIDE BLOCKING IN WALL",
    r"PROVIDE HANDICAPPED COMPLIANT",
    r"PRODUCT INFORMATION, INSTALLATION METHODS",
    r"Color:\s*STAIRS",
    r"Type:\s*EXIST",
    r"^(ALL\s+WORK\s+SHALL\s+BE\s+PERFORMED|CONTRACTOR\s+SHALL\s+BE\s+RESPONSIBLE|THE\s+CONTRACTOR\s+SHALL|WRITING\s+BY\s+THE\s+ARCHITECT|CONSTRUCTION\s+FOR\s+USE\s+BY\s+ALL\s+TRADES|SEQUENCE\s+OF\s+INSTALLATION|COORDINATE\s+WORK\s+OF\s+VARIOUS|EFFICIENTLY\s+TO\s+MAXIMIZE|SUPPLEMENTARY\s+PRINTS\s+AND|MATERIAL\s+EFFECT\s+UPON|REHABILITATION\s+NATURE\s+OR|ON\s+THE\s+PRINTS\s+AND\s+NOT|FURNISH\s+ALL\s+SUCH\s+MATERIALS)",
    r"^(BE\s+PROVIDED\s+IN\s+WALLS\s+ABOVE\s+CEILINGS|FIXTURE\s+SCHEDULE\s+&\s+MANUFACTURER|INSTALLATION\.\s+COORDINATE\s+BLOCKING|PROVIDE\s+UP\s+TO\s+\(4\)\s+ROWS|CABINETS\)\s+INSTALLATION\.|PROVIDE\s+FULL\s+SHEET\s+OF\s+IPC|A\s+COMPLETE\s+INSTALLATION\.|PROVIDE\s+BRADLEY\s+UTILITY\s+SHELF|WALL\s+FOR\s+INSTALLATION\s+OF\s+SHELF|PROVIDE\s+FIRE\s+EXTINGUISHER\s+AND\s+CABINET|COMPLY\s+WITH\s+ADA\s+INSTALLATION|INFILL\s+PROVIDED\s+BY\s+MANUFACTURER|CEILING\s+HEIGHTS\s+NOTED\s+ARE\s+MINIMUMS|REGULATIONS\s+AS\s+PROVIDED\s+BY|KICK-OFF\s+MEETING\s+BETWEEN|SUBMIT\s+COPIES\s+OF\s+APPROVED|MAINTENANCE\s+MANUALS\s+INCLUDING|AS-BUILT\s+DRAWINGS\.|REGULATIONS\s+OF\s+ALL\s+LOCAL)",
    r"^(BUSHINGS\s+AND\s+ARE\s+TO\s+BE\s+SEALED|A\.\s+STRUCTURAL\s+STEEL|GAS,\s+AND\s+WITH\s+OUTLETS|PROVIDE\s+SPRINKLERS\s+TO\s+PROTECT|PROVIDE\s+WATTS\s+SERIES|INSTALL\s+THERMOSTATS|COORDINATE\s+CEILING\s+TYPE|FACTORY\s+UNIT\s+MOUNTED\s+THERMOSTAT|VERIFY\s+CEILING\s+TYPE|PROVIDE\s+GRAVITY\s+BACKDRAFT|PROVIDE\s+FACTORY\s+MOUNTED|PROVIDE\s+UNIT\s+MOUNTED|PROVIDE\s+ENTHALPY\s+ECONOMIZER|MECHANICAL\s+CONTRACTOR\s+SHALL\s+INSTALL|PROVIDE\s+AUTOMATIC\s+CONDENSATE|ALL\s+RECEPTACLES\s+DESIGNATED|SEALING\s+OF\s+RACEWAYS|ALL\s+120\s+VOLT|ALL\s+POWER\s+SUPPLIES\s+REQUIRED|SHALL\s+BE\s+INSTALLED\s+IN\s+CONDUIT|MACHINERY/EQUIPMENT\s+AND\s+DROPS|LIQUID-TITE\s+FLEXIBLE\s+METAL\s+CONDUIT|ROUGH-IN,\s+PROVIDE\s+CATEGORY|EXISTING\s+2000A|SHALL\s+BE\s+INSTALLED\s+INDOORS|TEL/DATA\s+COMMUNICATIONS\s+SCOPE|PROVIDE\s+ROOM\s+CONTROLLER|FIRE\s+ALARM\s+SYSTEM\s+-\s+FIRE\s+SMOKE)",
    r"^(8\.\s+CEILING\s+HEIGHTS|1\.\s+TENANT|2\.\s+PRIOR\s+TO\s+CONSTRUCTION|3\.\s+PRIOR\s+TO\s+CONSTRUCTION|4\.\s+AT\s+THE\s+COMPLETION|OBTAIN\s+AND\s+FURNISH\s+TO\s+THE\s+OWNER|HIS/HER\s+CONTRACT\s+AND\s+NOT|THEREWITH|HEATING,\s+AND\s+TO\s+PREVENT|FACILITIES\s+WITHOUT\s+PERMISSION|2\.\s+ERECT\s+TEMPORARY|4\.\s+ERECT\s+A\s+PLAINLY|5\.\s+TEMPORARY\s+FACILITIES|EXISTING\s+CONSTRUCTION\s+ON\s+EXTERIOR|9\.\s+COVER\s+AND\s+PROTECT|10\.\s+TEMPORARY\s+ENCLOSURES|CONSTRUCTION\s+OPERATIONS|11\.\s+WHERE\s+HEATING|NECESSARY\s+SHORING\s+AND\s+PROVIDE|DAMAGE\.\s+THE\s+CONTRACTOR|SELECTIVE\s+DEMOLITION|3\.\s+INVENTORY\s+AND\s+RECORD|IN\s+WRITING\s+BY\s+OWNER|4\.\s+PERFORM\s+ALL\s+WORK|CLEAN\s+AND\s+READY\s+TO\s+RECEIVE)",
    r"^(AND\s+CONSTRUCTION,\s+IN\s+PROGRESS|CONSTRUCTION\s+AND\s+AS\s+INDICATED|METHODS\s+LEAST\s+LIKELY|22\.\s+RETURN\s+ELEMENTS|24\.\s+EXISTING\s+ITEMS|PHASES\s+INCLUDING\s+BIDDING|OF\s+INSTALLED\s+MATERIALS|PLUMB\s+WITHIN\s+INDUSTRY|6\.\s+THE\s+GENERAL\s+CONTRACTOR|7\.\s+WORK\s+DAMAGED|MANUFACTURER\'S\s+INSTRUCTIONS|13\.\s+GENERAL\s+CONTRACTOR|16\.\s+GENERAL\s+CONTRACTOR|INSTALLING\s+ANY\s+EQUIPMENT|24\.\s+THE\s+GENERAL\s+CONTRACTOR|WITH\s+DRYWALL\s+AND/OR|CONSTRUCTION\s+TO\s+REMAIN|CONSTRUCTION\s+NOT\s+LEVEL|ROOF\s+OPENINGS|STRIKE\s+SIDE\s+OF\s+DOORS|EQUIPMENT\s+LOCATIONS\s+WITH\s+OWNER)",
    r"^Local Source\s+\(Split System\)",
    r":\s+Local Source\s+\(Split System\)",
    r"ON\s+A\s+DROP/RISE\s+IN\s+SPACE\s+TEMPERATURE",
    r"ALL\s+WIRING\s+/\s+CIRCUITING",
    r"Remove Existing\s+(CONSTRUCTION ONLY|FLOOR FINISHES|INTERIOR AND EXTERIOR DOORS|PARTITION WALL)",
    r"^a\.\s+Doors:",
    r'^58""?x14""?\s+Duct$',
    r'^19""?x23""?\s+Duct$',
    '^4\\\'""?x8\\\'""?\\s+Duct$',
    r'^2""?x2""?\s+Duct$',
    r'^2""?x3""?\s+Duct$',
    r'^2""?x6""?\s+Duct$',
    r'^2""?x18""?\s+Duct$',
    r'^2""?x26""?\s+Duct$',
    r'^4""?x5""?\s+Duct$',
    r'^4""?\s+Dia\s+Duct$',
    r'^8""?x50""?\s+Duct$',
    r'^24""?x8""?\s+Duct$',
    r'^14""?x18""?\s+Duct$',
    r'^24""?x24""?\s+Duct$',
    r'^24""?x12""?\s+Duct$',
    r'^12""?x12""?\s+Duct$',
    r'^8""?x8""?\s+Duct$',
    r'^1"\s+Condensate\s+Line$',
    r"^Remove\s+Existing\s+VCT$",
    r"^Remove\s+Existing\s+DOOR$",
    r"^Ceiling\s+Finish:\s+CL-0[124]$",
    r"^ASTM-\d+$",
    r"^NFPA-\d+[A-Z]?$",
    r"^RJ45$",
    r"^UL\s*\d+$",
    r"^ANSI\s*/?\s*[A-Z]*\d+$",
    r"^(AE|EP|E|STD|IBC|EIA|LM|ASTM|NFPA|IP)\s*[-]?\d+[A-Z]?$",
    r"^LM-\d+$",
    r"^T-\d+$",
    r"^IP\d+$",
    r"^VA-\d+$",
    r"^PANELS?$",
    r"^DIBD\d+$",
    r"^SP\d+L?$",
    r"^MR\d+$",
    r"^LGPW-\d+$",
    r"^PBE\d+$",
    r"^ED-\d+$",
    r"^EY-\d+$",
    r"^casework$",
    r"^lights$",
    r"^(CG|GR|DR|TS|CR|WC|WB|CPT|LVT|FT|WB|TR|QT|SS|PL)-\d+$",
)
# Patterns of the second rule pipeline.
FALSE_POSITIVES_V2 = (
    r"^i\.\s+\$\d+",
    r"^\d+\.\s+(SEE|COORDINATE|PROVIDE|INSTALL|CONTRACTOR|MAINTAIN|ANY\s+ITEM|THE\s+CONTRACTOR|WHERE\s+DUCTS|OBTAIN\s+AND|FURNISH\s+ALL|SEQUENCE\s+OF|COORIDNATE\s+WORK|SUPPLAMENTARY\s+PRINTS|MATERIAL\s+EFFECT|REHABILITATION|ON\s+THE\s+PRINTS|HIS/HER\s+CONTRACT|THEREWITH|1\.\s+MAINTAIN|2\.\s+PROVIDE|3\.\s+PROVIDE|4\.\s+AT\s+THE|5\.\s+TEMPORARY|6\.\s+PROVIDE|1\.\s+TENANT|2\.\s+PRIOR|3\.\s+PRIOR|4\.\s+AT\s+THE)",
    r"^SECTION\s+\d+",
    r"^FOR DOOR",
    r"PROVIDE BLOCKING IN WALL",
    r"PROVIDE HANDICAPPED COMPLIANT",
    r"PRODUCT INFORMATION, INSTALLATION METHODS",
    r"Color:\s*STAIRS",
    r"Type:\s*EXIST",
    r"^(ALL\s+WORK\s+SHALL\s+BE\s+PERFORMED|CONTRACTOR\s+SHALL\s+BE\s+RESPONSIBLE|THE\s+CONTRACTOR\s+SHALL|WRITING\s+BY\s+THE\s+ARCHITECT|CONSTRUCTION\s+FOR\s+USE\s+BY\s+ALL\s+TRADES|SEQUENCE\s+OF\s+INSTALLATION|COORDINATE\s+WORK\s+OF\s+VARIOUS|EFFICIENTLY\s+TO\s+MAXIMIZE|SUPPLEMENTARY\s+PRINTS\s+AND|MATERIAL\s+EFFECT\s+UPON|REHABILITATION\s+NATURE\s+OR|ON\s+THE\s+PRINTS\s+AND\s+NOT|FURNISH\s+ALL\s+SUCH\s+MATERIALS)",
    r"^(BE\s+PROVIDED\s+IN\s+WALLS\s+ABOVE\s+CEILINGS|FIXTURE\s+SCHEDULE\s+&\s+MANUFACTURER|INSTALLATION\.\s+COORDINATE\s+BLOCKING|PROVIDE\s+UP\s+TO\s+\(4\)\s+ROWS|CABINETS\)\s+INSTALLATION\.|PROVIDE\s+FULL\s+SHEET\s+OF\s+IPC|A\s+COMPLETE\s+INSTALLATION\.|PROVIDE\s+BRADLEY\s+UTILITY\s+SHELF|WALL\s+FOR\s+INSTALLATION\s+OF\s+SHELF|PROVIDE\s+FIRE\s+EXTINGUISHER\s+AND\s+CABINET|COMPLY\s+WITH\s+ADA\s+INSTALLATION|INFILL\s+PROVIDED\s+BY\s+MANUFACTURER|CEILING\s+HEIGHTS\s+NOTED\s+ARE\s+MINIMUMS|REGULATIONS\s+AS\s+PROVIDED\s+BY|KICK-OFF\s+MEETING\s+BETWEEN|SUBMIT\s+COPIES\s+OF\s+APPROVED|MAINTENANCE\s+MANUALS\s+INCLUDING|AS-BUILT\s+DRAWINGS\.|REGULATIONS\s+OF\s+ALL\s+LOCAL)",
    r"^(BUSHINGS\s+AND\s+ARE\s+TO\s+BE\s+SEALED|A\.\s+STRUCTURAL\s+STEEL|GAS,\s+AND\s+WITH\s+OUTLETS|PROVIDE\s+SPRINKLERS\s+TO\s+PROTECT|PROVIDE\s+WATTS\s+SERIES|INSTALL\s+THERMOSTATS|COORDINATE\s+CEILING\s+TYPE|FACTORY\s+UNIT\s+MOUNTED\s+THERMOSTAT|VERIFY\s+CEILING\s+TYPE|PROVIDE\s+GRAVITY\s+BACKDRAFT|PROVIDE\s+FACTORY\s+MOUNTED|PROVIDE\s+UNIT\s+MOUNTED|PROVIDE\s+ENTHALPY\s+ECONOMIZER|MECHANICAL\s+CONTRACTOR\s+SHALL\s+INSTALL|PROVIDE\s+AUTOMATIC\s+CONDENSATE|ALL\s+RECEPTACLES\s+DESIGNATED|SEALING\s+OF\s+RACEWAYS|ALL\s+120\s+VOLT|ALL\s+POWER\s+SUPPLIES\s+REQUIRED|SHALL\s+BE\s+INSTALLED\s+IN\s+CONDUIT|MACHINERY/EQUIPMENT\s+AND\s+DROPS|LIQUID-TITE\s+FLEXIBLE\s+METAL\s+CONDUIT|ROUGH-IN,\s+PROVIDE\s+CATEGORY|EXISTING\s+2000A|SHALL\s+BE\s+INSTALLED\s+INDOORS|TEL/DATA\s+COMMUNICATIONS\s+SCOPE|PROVIDE\s+ROOM\s+CONTROLLER|FIRE\s+ALARM\s+SYSTEM\s+-\s+FIRE\s+SMOKE|9\.\s+ALL\s+RECEPTACLES|14\.\s+ALL\s+120|15\.\s+ALL\s+POWER|31\.\s+ALL\s+POWER|SHALL\s+BE\s+INSTALLED\s+INDOORS|LIQUID-TITE\s+FLEXIBLE|MACHINERY/EQUIPMENT)",
    r"^(8\.\s+CEILING\s+HEIGHTS|1\.\s+TENANT|2\.\s+PRIOR\s+TO\s+CONSTRUCTION|3\.\s+PRIOR\s+TO\s+CONSTRUCTION|4\.\s+AT\s+THE\s+COMPLETION|OBTAIN\s+AND\s+FURNISH\s+TO\s+THE\s+OWNER|HIS/HER\s+CONTRACT\s+AND\s+NOT|THEREWITH|HEATING,\s+AND\s+TO\s+PREVENT|FACILITIES\s+WITHOUT\s+PERMISSION|2\.\s+ERECT\s+TEMPORARY|4\.\s+ERECT\s+A\s+PLAINLY|5\.\s+TEMPORARY\s+FACILITIES|EXISTING\s+CONSTRUCTION\s+ON\s+EXTERIOR|9\.\s+COVER\s+AND\s+PROTECT|10\.\s+TEMPORARY\s+ENCLOSURES|CONSTRUCTION\s+OPERATIONS|11\.\s+WHERE\s+HEATING|NECESSARY\s+SHORING\s+AND\s+PROVIDE|DAMAGE\.\s+THE\s+CONTRACTOR|SELECTIVE\s+DEMOLITION|3\.\s+INVENTORY\s+AND\s+RECORD|IN\s+WRITING\s+BY\s+OWNER|4\.\s+PERFORM\s+ALL\s+WORK|CLEAN\s+AND\s+READY\s+TO\s+RECEIVE)",
    r"^(AND\s+CONSTRUCTION,\s+IN\s+PROGRESS|CONSTRUCTION\s+AND\s+AS\s+INDICATED|METHODS\s+LEAST\s+LIKELY|22\.\s+RETURN\s+ELEMENTS|24\.\s+EXISTING\s+ITEMS|PHASES\s+INCLUDING\s+BIDDING|OF\s+INSTALLED\s+MATERIALS|PLUMB\s+WITHIN\s+INDUSTRY|6\.\s+THE\s+GENERAL\s+CONTRACTOR|7\.\s+WORK\s+DAMAGED|MANUFACTURER\'S\s+INSTRUCTIONS|13\.\s+GENERAL\s+CONTRACTOR|16\.\s+GENERAL\s+CONTRACTOR|INSTALLING\s+ANY\s+EQUIPMENT|24\.\s+THE\s+GENERAL\s+CONTRACTOR|WITH\s+DRYWALL\s+AND/OR|CONSTRUCTION\s+TO\s+REMAIN|CONSTRUCTION\s+NOT\s+LEVEL|ROOF\s+OPENINGS|STRIKE\s+SIDE\s+OF\s+DOORS|EQUIPMENT\s+LOCATIONS\s+WITH\s+OWNER)",
    r"^Local Source\s+\(Split System\)",
    r":\s+Local Source\s+\(Split System\)",
    r"ON\s+A\s+DROP/RISE\s+IN\s+SPACE\s+TEMPERATURE",
    r"ALL\s+WIRING\s+/\s+CIRCUITING",
    r"Remove Existing\s+(CONSTRUCTION ONLY|FLOOR FINISHES|INTERIOR AND EXTERIOR DOORS|PARTITION WALL)",
    r"^a\.\s+Doors:",
    r'^58""?x14""?\s+Duct$',
    r'^19""?x23""?\s+Duct$',
    '^4\\\'""?x8\\\'""?\\s+Duct$',
    r'^2""?x2""?\s+Duct$',
    r'^2""?x3""?\s+Duct$',
    r'^2""?x6""?\s+Duct$',
    r'^2""?x18""?\s+Duct$',
    r'^2""?x26""?\s+Duct$',
    r'^4""?x5""?\s+Duct$',
    r'^4""?\s+Dia\s+Duct$',
    r'^8""?x50""?\s+Duct$',
    r'^24""?x8""?\s+Duct$',
    r'^14""?x18""?\s+Duct$',
    r'^24""?x24""?\s+Duct$',
    r'^24""?x12""?\s+Duct$',
    r'^12""?x12""?\s+Duct$',
    r'^8""?x8""?\s+Duct$',
    r'^1"\s+Condensate\s+Line$',
    r"^Remove\s+Existing\s+VCT$",
    r"^Remove\s+Existing\s+DOOR$",
    r"^Ceiling\s+Finish:\s+CL-0[124]$",
)
