"""Vocabularies, rates, limits and weights that results depend on."""

# Settings
BUILD_QUANTITY = 100
LEAD_WARN_DAYS, LEAD_CRITICAL_DAYS = 84, 168
STOCK_BUFFER_PCT = 10
MIN_SOURCES = 2
REVIEW_CONFIDENCE = 90
FUZZY_SIMILARITY = 88
COMPLETION_CONFIDENCE = 70
SIMILAR_BONUS = 6  # of an alternate that is a similar part
SOURCE_BONUS = {"bom": 26, "substitution": 18, "similar": 6, "search": 0}  # of an alternate, by its source
PUBLISHED_ALTERNATES = 6  # of a part that count
MAX_ALTERNATES = 5
WEIGHTS = {"lifecycle": 1.0, "availability": 1.0, "sourcing": 0.8, "lead_time": 0.7, "compliance": 0.6, "data_quality": 0.5, "cost": 0.4}

# Units of each currency for one US dollar, in hundredths
FX_CENTS = {
    "USD": 100, "EUR": 92, "GBP": 79, "JPY": 15200, "INR": 8340, "CNY": 724, "CAD": 136, "AUD": 152, "CHF": 89, "SEK": 1050, "SGD": 134, "KRW": 134000, "HKD": 782,
    "TWD": 3180, "MXN": 1710, "BRL": 505, "PLN": 397, "NOK": 1060, "DKK": 687, "ILS": 371, "TRY": 3220, "ZAR": 1870, "NZD": 164, "THB": 3580, "MYR": 472, "PHP": 5630,
    "VND": 2470000, "IDR": 1570000, "CZK": 2320, "HUF": 36000, "RON": 457,
}

# Lifecycle and compliance states with their ranks
LIFECYCLE_RANK = {"Active": 0, "New": 1, "Unknown": 2, "NRND": 3, "EOL": 4, "Obsolete": 5}
LIFECYCLE_RISK = {"Active": 0, "New": 8, "Unknown": 35, "NRND": 65, "EOL": 88, "Obsolete": 100}
COMPLIANCE_RANK = {"Unknown": 0, "Compliant": 1, "Exempt": 2, "Non-compliant": 3}
SEVERITY_RANK = {"info": 0, "warning": 1, "error": 2}

# Lifecycle wording, tried in this order
LIFECYCLE_WORDS = {
    "Obsolete": ("obsolete", "discontinued", "cancelled", "canceled", "inactive", "not manufactured", "no longer", "end of sale", "eos", "dead", "unavailable - obsolete", "phase out complete"),
    "EOL": ("end of life", "eol", "last time buy", "ltb", "last buy", "end-of-life", "phase out", "phasing out", "pending obsolescence", "scheduled for obsolescence"),
    "NRND": ("nrnd", "not recommended", "not for new design", "not recommended for new design", "not recommended for new designs", "mature", "legacy", "limited availability", "maintenance"),
    "New": ("new", "new product", "preliminary", "pre-production", "prerelease", "pre-release", "introduced", "recently introduced", "sampling"),
    "Active": ("active", "production", "in production", "available", "released", "volume production", "normal", "standard", "current", "mass production", "recommended", "unknown active", "acquired"),
}
EXEMPT_PHRASES = ("by exemption", "with exemption", "exemption applies")
EXEMPT_WORDS = ("exempt", "exemption", "exempted")
FAIL_PHRASES = ("non-compliant", "non compliant", "not compliant", "non_compliant", "noncompliant", "not rohs", "non-rohs", "non rohs", "does not comply", "not in compliance", "contains svhc", "above threshold")
FAIL_WORDS = ("no", "n", "false", "fail", "failed", "contains", "noncompliant")
NOT_A_FAIL = ("no exemption", "no svhc", "no restricted")
PASS_PHRASES = ("rohs 3", "rohs3", "lead free", "lead-free", "pb free", "pb-free", "in compliance", "fully compliant", "rohs compliant", "reach compliant", "svhc free", "no svhc", "below threshold")
PASS_WORDS = ("compliant", "yes", "y", "true", "conform", "conforms", "pass", "passed", "compatible", "compliance", "green", "ok")

# Marks of lines that aren't populated or have no part
DNP_TOKENS = (
    "DNP", "DNI", "DNF", "DNNP", "NOPOP", "NOTPOPULATED", "NOPLACE", "DONOTPOPULATE", "DONOTINSTALL", "DONOTFIT", "DNM", "NOTFITTED", "NF", "OMIT", "OMITTED", "UNPOPULATED", "SPARE",
    "NOTUSED", "NU", "OPEN", "NOTLOADED", "DNL", "XOUT",
)
NO_PART_TOKENS = (
    "NOPART", "TBD", "TOBEDETERMINED", "TBA", "PLACEHOLDER", "UNKNOWN", "SEEDRAWING", "REFONLY", "REFERENCEONLY", "MECHANICAL", "DOCUMENTATION", "ASSEMBLYONLY", "VIRTUAL", "NOBOM", "DONOTORDER",
)
NULL_TOKENS = ("nan", "none", "null", "n/a", "na", "#n/a", "-", "--", "#value!", "#ref!", "#name?", "(blank)", "<blank>")

# Packaging marks at the end of a part number
PACKAGING_SUFFIXES = (
    "-ND", "-TR", "-TR13", "-TRPBF", "-T", "-TA", "-TB", "-TE", "-TL", "-CT", "-DKR", "-2", "-1", "-REEL", "-REEL7", "-BULK", "-TUBE", "-TRAY", "-PBFREE", "-PBF", "-CUT", "-RL", "-RL7", "-A",
    "-AMMO", "/TR", "/T", "/TR13", "/REEL", "/BULK", "/CUT", "#PBF", "#TR",
)

# Chip sizes, metric to imperial, and package spellings
METRIC_CHIPS = {"0603": "0201", "1005": "0402", "1608": "0603", "2012": "0805", "3216": "1206", "3225": "1210", "4532": "1812", "5025": "2010", "6332": "2512", "0402": "01005"}
PACKAGE_ALIASES = {
    "SOT23": "SOT-23", "SOT233": "SOT-23-3", "SOT235": "SOT-23-5", "SOT236": "SOT-23-6", "SOT323": "SOT-323", "SOT89": "SOT-89", "SOT223": "SOT-223", "TSOT23": "TSOT-23", "SOIC8": "SOIC-8",
    "SO8": "SOIC-8", "SOP8": "SOIC-8", "SOIC14": "SOIC-14", "SOIC16": "SOIC-16", "TSSOP8": "TSSOP-8", "TSSOP14": "TSSOP-14", "TSSOP16": "TSSOP-16", "TSSOP20": "TSSOP-20", "MSOP8": "MSOP-8",
    "MSOP10": "MSOP-10", "QFN16": "QFN-16", "QFN20": "QFN-20", "QFN24": "QFN-24", "QFN32": "QFN-32", "QFN48": "QFN-48", "LQFP32": "LQFP-32", "LQFP48": "LQFP-48", "LQFP64": "LQFP-64",
    "LQFP100": "LQFP-100", "LQFP144": "LQFP-144", "TQFP32": "TQFP-32", "TQFP44": "TQFP-44", "TQFP64": "TQFP-64", "DIP8": "DIP-8", "PDIP8": "DIP-8", "DIP14": "DIP-14", "DIP16": "DIP-16",
    "TO220": "TO-220", "TO2203": "TO-220-3", "TO247": "TO-247", "TO252": "TO-252", "DPAK": "TO-252", "TO263": "TO-263", "D2PAK": "TO-263", "TO92": "TO-92", "SMA": "DO-214AC", "SMB": "DO-214AA",
    "SMC": "DO-214AB", "SOD123": "SOD-123", "SOD323": "SOD-323", "SOD523": "SOD-523", "BGA": "BGA", "UFBGA": "UFBGA", "WLCSP": "WLCSP",
}
MOUNT_TOKENS = ("THT", "SMD", "SMT", "TH", "THROUGHHOLE", "SURFACEMOUNT")
TOLERANCE_LETTERS = {"B": 0.1, "C": 0.25, "D": 0.5, "F": 1.0, "G": 2.0, "J": 5.0, "K": 10.0, "M": 20.0, "Z": 30.0}

# The dossier: authority of sources, dollars for a unit of currency in ten-thousandths, risk of states in thousandths, weights of
# lifecycle, stock, lead time, vendors, price trend and manufacturer, and function groups by keyword in this order
SOURCE_RANK = {"manufacturer": 0, "distributor": 1, "mock": 2}
DOSSIER_RATES = {"USD": 10000, "EUR": 10900, "GBP": 12700, "INR": 120, "JPY": 67, "CNY": 1400}
DOSSIER_LIFECYCLE = {"Active": 0, "New": 0, "NRND": 300, "EOL": 600, "Last time buy": 800, "Obsolete": 1000, "Unknown": 500}
DOSSIER_WEIGHTS = (40, 20, 15, 10, 10, 5)
CATEGORY_GROUPS = {
    "regulator": "power", "switching": "power", "transistor": "discrete", "mosfet": "discrete", "diode": "discrete", "microcontroller": "mcu", "microprocessor": "mcu", "op amp": "analog", "adc": "analog",
    "dac": "analog", "switch": "analog", "transceiver": "comms", "bridge": "comms", "interface": "comms", "logic": "logic", "buffer": "logic", "register": "logic",
}

# Engineering values: unit words by kind, prefixes (a capital M apart), and what values are written with
UNIT_KINDS = {
    "F": "capacitance", "FARAD": "capacitance", "FARADS": "capacitance", "OHM": "resistance", "OHMS": "resistance", "Ω": "resistance", "R": "resistance", "E": "resistance",
    "H": "inductance", "HENRY": "inductance", "HENRIES": "inductance", "HZ": "frequency", "HERTZ": "frequency", "V": "voltage", "VOLT": "voltage", "VOLTS": "voltage", "VDC": "voltage",
    "A": "current", "AMP": "current", "AMPS": "current", "AMPERE": "current", "W": "power", "WATT": "power", "WATTS": "power",
}
SI_PREFIXES = {
    "f": 1e-15, "p": 1e-12, "n": 1e-9, "u": 1e-6, "µ": 1e-6, "μ": 1e-6, "m": 1e-3, "k": 1e3, "K": 1e3, "G": 1e9, "g": 1e9, "T": 1e12, "t": 1e12,
    "R": 1.0, "r": 1.0, "E": 1.0, "e": 1.0, "P": 1e-12, "N": 1e-9, "U": 1e-6, "F": 1e-15, "MEG": 1e6, "meg": 1e6, "Meg": 1e6,
}
ENGINEERING = ((1e12, "T"), (1e9, "G"), (1e6, "M"), (1e3, "k"), (1.0, ""), (1e-3, "m"), (1e-6, "µ"), (1e-9, "n"), (1e-12, "p"), (1e-15, "f"))
KIND_UNITS = {"resistance": "Ω", "capacitance": "F", "inductance": "H", "frequency": "Hz", "voltage": "V", "current": "A", "power": "W"}
THT_MARKS = ("DIP-", "TO-92", "TO-220", "TO-247", "TO-3", "RADIAL", "AXIAL", "THT", "THROUGH")
SMD_MARKS = ("SOIC", "TSSOP", "MSOP", "QFN", "QFP", "BGA", "CSP", "SOT", "SOD", "DO-214", "TO-252", "TO-263", "SON", "DFN")

# Currency symbols and codes, looked for in this order
CURRENCY_SYMBOLS = {
    "$": "USD", "US$": "USD", "USD": "USD", "€": "EUR", "EUR": "EUR", "£": "GBP", "GBP": "GBP", "¥": "JPY", "JPY": "JPY", "JP¥": "JPY", "₹": "INR", "INR": "INR", "RS": "INR", "RS.": "INR",
    "CNY": "CNY", "RMB": "CNY", "￥": "CNY", "CAD": "CAD", "C$": "CAD", "AUD": "AUD", "A$": "AUD", "CHF": "CHF", "SEK": "SEK", "SGD": "SGD", "S$": "SGD", "KRW": "KRW", "₩": "KRW",
    "HKD": "HKD", "TWD": "TWD", "MXN": "MXN", "BRL": "BRL", "PLN": "PLN", "NOK": "NOK", "DKK": "DKK", "ILS": "ILS", "TRY": "TRY", "ZAR": "ZAR", "NZD": "NZD", "THB": "THB", "MYR": "MYR",
    "PHP": "PHP", "VND": "VND", "IDR": "IDR", "CZK": "CZK", "HUF": "HUF", "RON": "RON",
}

# Words that many companies share, and spellings of the commonest makers and distributors; further ones are a parameter
COMPANY_NOISE = (
    "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "LLC", "PLC", "GMBH", "AG", "SA", "SAS", "NV", "BV", "AB", "OY", "KK", "PTE", "PVT", "PRIVATE", "GROUP",
    "HOLDINGS", "THE", "TECHNOLOGY", "TECHNOLOGIES", "SEMICONDUCTOR", "SEMICONDUCTORS", "ELECTRONIC", "ELECTRONICS", "COMPONENTS", "INDUSTRIES", "INTERNATIONAL", "MICROELECTRONICS", "PRODUCTS",
    "DEVICES", "SOLUTIONS", "AMERICA", "USA", "EUROPE", "JAPAN", "KOREA", "TAIWAN", "CHINA", "AND",
)
MAKER_ALIASES = {
    "Texas Instruments": ("TI", "Texas Instrument", "Texas Inst", "Burr-Brown", "National Semiconductor", "NatSemi", "TI Inc"),
    "STMicroelectronics": ("ST", "ST Micro", "ST Microelectronics", "SGS-Thomson", "STM"),
    "Analog Devices": ("ADI", "Analog Devices Inc", "Linear Technology", "Linear Tech", "LTC", "Maxim Integrated", "Maxim", "Hittite"),
    "Microchip Technology": ("Microchip", "Atmel", "Micrel", "SST", "Microsemi"),
    "NXP Semiconductors": ("NXP", "Freescale", "Freescale Semiconductor", "Philips Semiconductors"),
    "Infineon Technologies": ("Infineon", "International Rectifier", "IR", "Cypress", "Cypress Semiconductor", "Ramtron"),
    "ON Semiconductor": ("ON Semi", "Onsemi", "Fairchild", "Fairchild Semiconductor", "AMI Semiconductor"),
    "Renesas Electronics": ("Renesas", "Intersil", "IDT", "Integrated Device Technology", "Dialog Semiconductor", "Dialog", "NEC Electronics"),
    "Murata Electronics": ("Murata", "Murata Manufacturing", "Murata Mfg", "Toko"),
    "TDK Corporation": ("TDK", "TDK-EPC", "EPCOS", "TDK Epcos", "InvenSense"),
    "Samsung Electro-Mechanics": ("Samsung", "SEMCO", "Samsung Electro Mechanics"),
    "Yageo": ("Yageo Corporation", "Phycomp", "KEMET", "Kemet", "NIC Components"),
    "Vishay": ("Vishay Intertechnology", "Vishay Dale", "Vishay Sprague", "Vishay Beyschlag", "Dale", "Sprague", "Siliconix", "Vishay Siliconix"),
    "Panasonic": ("Panasonic Electronic Components", "Matsushita", "Panasonic Industrial"),
    "Wurth Elektronik": ("Wurth", "Würth", "Würth Elektronik", "WE", "Wurth Electronics"),
    "TE Connectivity": ("TE", "Tyco Electronics", "Tyco", "AMP", "Raychem", "Deutsch"),
    "Molex": ("Molex Connector", "Molex LLC"),
    "Rohm Semiconductor": ("Rohm", "Lapis", "Lapis Semiconductor"),
    "Diodes Incorporated": ("Diodes Inc", "Diodes", "Zetex", "Pericom"),
    "Skyworks Solutions": ("Skyworks", "Silicon Labs", "Silicon Laboratories", "SiLabs"),
    "Broadcom": ("Avago", "Avago Technologies", "LSI"),
    "Nordic Semiconductor": ("Nordic", "Nordic Semi"),
    "AMD Xilinx": ("Xilinx", "AMD"),
    "Intel": ("Altera", "Intel PSG"),
}
DISTRIBUTOR_ALIASES = {
    "DigiKey": ("Digi-Key", "Digi Key", "DigiKey Electronics", "Digi-Key Electronics", "DK"),
    "Mouser Electronics": ("Mouser", "Mouser Electronics Inc"),
    "Arrow Electronics": ("Arrow", "Arrow Electronics Inc", "Arrow.com", "Verical"),
    "Farnell": ("Farnell element14", "Farnell / element14", "element14", "Premier Farnell", "Newark", "Newark element14", "element14 APAC"),
    "RS Components": ("RS", "RS-Online", "RS Online", "Allied Electronics", "Allied Electronics & Automation"),
    "LCSC Electronics": ("LCSC", "LCSC.com", "Szlcsc"),
    "Avnet": ("Avnet Americas", "Avnet Europe", "Avnet Asia", "Avnet Abacus", "EBV Elektronik"),
    "TTI": ("TTI Inc", "TTI Inc.", "TTI Europe"),
    "Future Electronics": ("Future", "FAI"),
}

# The dossier's hints, the first prefix that fits counts
PREFIX_MAKERS = (
    ("STM32", "STMicroelectronics"), ("STM8", "STMicroelectronics"), ("ST", "STMicroelectronics"), ("ATTINY", "Microchip"), ("ATMEGA", "Microchip"), ("AT90", "Microchip"), ("AT28", "Microchip"),
    ("AT25", "Microchip"), ("AT24", "Microchip"), ("ATSAM", "Microchip"), ("ATSAMD", "Microchip"), ("PIC16", "Microchip"), ("PIC18", "Microchip"), ("PIC24", "Microchip"), ("ESP32", "Espressif"),
    ("ESP8266", "Espressif"), ("NRF52", "Nordic Semiconductor"), ("NRF51", "Nordic Semiconductor"), ("MSP430", "Texas Instruments"), ("CC13", "Texas Instruments"), ("CC26", "Texas Instruments"),
    ("TPS", "Texas Instruments"), ("LM", "Texas Instruments"), ("OPA", "Texas Instruments"), ("TLC", "Texas Instruments"), ("ADS", "Texas Instruments"), ("DAC", "Texas Instruments"),
    ("ADC", "Texas Instruments"), ("SN74", "Texas Instruments"), ("CD74", "Texas Instruments"), ("LPC", "NXP"), ("LM", "NXP"), ("74HC", "Nexperia"), ("74LVC", "Nexperia"), ("BC", "Nexperia"),
    ("NE555", "Texas Instruments"), ("SG3525", "STMicroelectronics"), ("USB", "Microchip"),
)
MAKER_SHORT_NAMES = {
    "TI": "Texas Instruments", "TEXAS": "Texas Instruments", "TEXAS INSTRUMENTS": "Texas Instruments", "STM": "STMicroelectronics", "STMICRO": "STMicroelectronics",
    "ST MICROELECTRONICS": "STMicroelectronics", "ATMEL": "Microchip", "MICROCHIP TECHNOLOGY": "Microchip", "NXP SEMICONDUCTORS": "NXP", "NXPSEMICONDUCTORSN.V.": "NXP",
    "INFINEON TECHNOLOGIES": "Infineon", "FAIRCHILD": "ON Semiconductor", "ON SEMI": "ON Semiconductor",
}
SUFFIX_PACKAGES = {
    "T6": "LQFP144", "VGT6": "LQFP100", "VET6": "LQFP100", "VIT6": "LQFP100", "RGT6": "LQFP64", "RET6": "LQFP64", "RCT6": "LQFP64", "C8T6": "LQFP48", "CBT6": "LQFP48", "C6T6": "LQFP48",
    "CBU7": "UFBGA48", "JTRS6": "WLCSP", "JYT6": "WLCSP",
}
PACKAGE_WORD = r"(?i)(SOIC[- ]?\d+|LQFP[- ]?\d+|TSSOP[- ]?\d+|QFN[- ]?\d+|DIP[- ]?\d+|SOT23[- ]?\d*|SOP[- ]?\d+)"

# Lifecycle: the state after each, the states that may follow, and events that are notices only
LIFECYCLE_NEXT = {"ACTIVE": "NRND", "NRND": "EOL_ANNOUNCED", "EOL_ANNOUNCED": "LAST_TIME_BUY", "LAST_TIME_BUY": "OBSOLETE"}
LIFECYCLE_GRAPH = {
    "ACTIVE": ("NRND", "EOL_ANNOUNCED", "UNKNOWN"), "NRND": ("EOL_ANNOUNCED", "ACTIVE", "UNKNOWN"), "EOL_ANNOUNCED": ("LAST_TIME_BUY", "OBSOLETE", "NRND", "ACTIVE", "UNKNOWN"),
    "LAST_TIME_BUY": ("OBSOLETE", "EOL_ANNOUNCED", "UNKNOWN"), "OBSOLETE": ("ACTIVE", "UNKNOWN"), "UNKNOWN": ("ACTIVE", "NRND", "EOL_ANNOUNCED", "LAST_TIME_BUY", "OBSOLETE", "UNKNOWN"),
}
NOTICE_EVENTS = ("PCN", "PDN")

# Component words in descriptions and the designator prefixes that go with them, tried in this order
TYPE_PREFIXES = (
    ("resistor|res|thermistor|potentiometer|trimmer", ("R", "RN", "RV", "RT", "VR", "P", "RP")),
    ("capacitor|cap|mlcc|tantalum|electrolytic", ("C", "CP", "CE", "CT")),
    ("inductor|choke|ferrite|bead|coil", ("L", "FB", "FL")),
    ("diode|zener|schottky|tvs|rectifier", ("D", "CR", "ZD", "TVS", "Z")),
    ("led|light emitting", ("D", "LED", "DS", "L")),
    ("transistor|mosfet|bjt|igbt|fet", ("Q", "T", "TR", "M")),
    ("connector|header|receptacle|socket|terminal|jack|plug", ("J", "P", "CN", "CON", "X", "TB", "S")),
    ("crystal|oscillator|resonator|xtal", ("X", "Y", "XT", "OSC", "Q")),
    ("switch|button|tactile|encoder", ("SW", "S", "BTN", "PB")),
    ("fuse|ptc|polyfuse", ("F", "FU")),
    ("relay|contactor", ("K", "RL", "RY")),
    ("transformer", ("T", "TR")),
    ("test ?point|testpoint", ("TP", "T")),
    ("antenna", ("E", "ANT", "AE")),
    ("battery|holder|coin cell", ("BT", "BAT", "B")),
    ("mounting hole|standoff|screw|nut|washer|spacer|bracket", ("MH", "H", "HW", "MP")),
    ("module|shield|board|pcb|assembly", ("U", "M", "A", "MOD", "PCB")),
)
BULK_PREFIXES = ("", "SOL", "ADH", "PST")

# Countries of origin to look at
REVIEW_ORIGINS = ("RU", "BY", "IR", "KP", "SY", "CU")

# Sheets: labels of title blocks, banners, totals; the commonest header words with their field and weight, further ones are
# a parameter; fields that a table needs, and how much fields count in halves (others 1)
TITLE_LABEL = r"(?i)^(project|program|product|assembly|assy|board|pcb|bom|part|drawing|dwg|revision|rev|version|date|prepared|approved|checked|author|engineer|customer|client|company|department|title|description|notes?|file|issue|status|page|sheet|quantity per|build|variant|configuration|document|doc|ecn|eco|released?|owner|created|modified)\b\s*[:\-]?\s*$"
SECTION_BANNER = r"(?i)^[\s\-=*_#]*(resistors?|capacitors?|inductors?|connectors?|semiconductors?|ics?|integrated circuits?|diodes?|transistors?|crystals?|oscillators?|leds?|switches?|fuses?|relays?|transformers?|mechanical|hardware|pcb|misc(ellaneous)?|passives?|actives?|electromechanical|section|group|category|smt|tht|assembly)[\s\-=*_#:]*$"
TOTAL_ROW = r"(?i)^(total|totals|grand total|sub[- ]?total|sum|subtotal|end of bom|end of list|notes?|legend|approved by|prepared by|checked by|signature|remarks?)\b"
HEADER_WORDS = {
    "mpn": ("mpn", 100), "manufacturerpartnumber": ("mpn", 100), "manufacturerpartno": ("mpn", 100), "mfrpartnumber": ("mpn", 99), "mfgpartnumber": ("mpn", 99), "mfrpn": ("mpn", 98), "partnumber": ("mpn", 98), "partno": ("mpn", 98), "pn": ("mpn", 97), "mfrpart": ("mpn", 97),
    "manufacturer": ("manufacturer", 100), "mfr": ("manufacturer", 100), "mfg": ("manufacturer", 100), "mfrname": ("manufacturer", 99), "manufacturername": ("manufacturer", 99), "make": ("manufacturer", 98), "maker": ("manufacturer", 98), "brand": ("manufacturer", 98), "vendor": ("manufacturer", 97),
    "qty": ("quantity", 100), "quantity": ("quantity", 100), "qnty": ("quantity", 100), "qtyperboard": ("quantity", 99), "count": ("quantity", 99), "pcs": ("quantity", 98), "usage": ("quantity", 98), "requiredquantity": ("quantity", 98),
    "reference": ("ref_designators", 100), "references": ("ref_designators", 100), "refdes": ("ref_designators", 99), "referencedesignator": ("ref_designators", 99), "referencedesignators": ("ref_designators", 98), "designator": ("ref_designators", 98), "designators": ("ref_designators", 98),
    "description": ("description", 100), "desc": ("description", 100), "partdescription": ("description", 100), "componentdescription": ("description", 99),
    "value": ("value", 100), "val": ("value", 100),
    "package": ("package", 100), "footprint": ("package", 100), "case": ("package", 100),
    "tolerance": ("tolerance", 100), "tol": ("tolerance", 100),
    "notes": ("notes", 100), "remarks": ("notes", 100), "comment": ("notes", 100),
    "item": ("line_id", 100), "itemno": ("line_id", 100), "line": ("line_id", 100), "lineno": ("line_id", 99),
}
REQUIRED_FIELDS = ("mpn", "quantity")
FIELD_HALVES = {"mpn": 6, "quantity": 4, "manufacturer": 3, "description": 2, "ref_designators": 2}

# Records in nested answers: fields that mark one, how deep they are looked for; words of parameters by the fact they tell, in this order
RECORD_MARKERS = ("partNumber", "mpn", "manufacturerPartNumber")
RECORD_DEPTH = 7
COMPLIANCE_NAMES = {
    "rohs": "rohs", "reach": "reach", "halogen_free": "halogen", "msl": "moisture sensitivity|^msl$", "aec_q": "automotive|aec", "country_of_origin": "country of origin|^coo$|^origin$", "hts_code": "hts|tariff",
    "eccn": "eccn|export control", "lead_free_process": "lead free|lead-free",
}

# Seconds after which a part's facts and its newest snapshot are stale
TIMES_TO_LIVE = {"fact": 86400, "snapshot": 900}

# Names of sheets that hold the table of parts, and of sheets that don't
SHEET_NAMED = r"(?i)(bom|bill of material|parts?|component|material|stückliste|nomenclature|lista)"
SHEET_NOT_NAMED = r"(?i)(instruction|readme|help|legend|notes?|history|revision|change|cover|title|template|pivot|chart|graph|summary|dashboard|do not|obsolete|old|backup|copy of)"

# Column mapping: the commonest spellings of each field's header, the more canonical first; further ones are a parameter.
# A spelling's weight is 100 less 0.4 for each before it. FIELD_PATTERNS are looked for in the header's key and in its text.
FIELD_WORDS = {
    "mpn": ("mpn", "manufacturer part number", "manufacturer part no", "manufacturer part #", "manufacturer pn", "manufacturer p/n", "mfr part number", "mfg part number"),
    "manufacturer": ("manufacturer", "mfr", "mfg", "mfr name", "mfg name", "manufacturer name", "make", "maker"),
    "quantity": ("qty", "quantity", "qnty", "qty.", "qty per board", "qty/board", "qty per assy", "qty per assembly"),
    "ref_designators": ("reference", "references", "refdes", "ref des", "ref-des", "ref designator", "reference designator", "reference designators"),
    "description": ("description", "desc", "descr", "part description", "component description", "item description", "long description", "short description"),
    "internal_pn": ("internal part number", "internal pn", "internal p/n", "ipn", "company part number", "house part number", "in house pn", "sku"),
    "value": ("value", "val", "component value", "nominal value", "rating", "resistance", "capacitance", "inductance"),
    "package": ("package", "pkg", "footprint", "case", "case code", "case size", "package type", "package/case"),
    "tolerance": ("tolerance", "tol", "tol.", "accuracy", "precision"),
    "voltage": ("voltage", "voltage rating", "rated voltage", "vdc", "wvdc", "working voltage"),
    "power": ("power", "power rating", "wattage", "watts", "rated power"),
    "alt_mpns": ("alternate", "alternates", "alternate part number", "alternate part numbers", "alternative", "alternatives", "alt part number", "alt pn"),
    "distributor": ("distributor", "dist", "supplier name", "source", "purchase from", "buy from"),
    "distributor_pn": ("distributor part number", "distributor pn", "distributor p/n", "dist pn", "dist part number", "digikey", "digi-key", "digikey part number"),
    "unit_price_in": ("price", "unit price", "unit cost", "cost", "cost each", "price each", "unit price usd", "target price"),
    "currency": ("currency", "curr", "ccy", "price currency"),
    "notes": ("notes", "note", "remark", "remarks", "comment", "comments"),
    "dnp": ("dnp", "dni", "do not populate", "do not place", "do not install", "populate", "install", "fitted"),
    "level": ("level", "bom level", "lvl", "indent"),
    "parent": ("parent", "parent assembly", "parent pn", "assembly"),
    "line_id": ("line", "line no", "line number", "line #", "item no", "item number", "seq", "sequence"),
}
FIELD_PATTERNS = {
    "mpn": (r"^m(fr|fg|anu)[a-z ]*part", r"part\s*(number|no|#|num)$", r"^mpn\b"),
    "manufacturer": (r"^m(fr|fg|anufactur)", r"^(vendor|supplier|brand)$"),
    "quantity": (r"^q(ty|nty|uantity)", r"\bqty\b", r"^no\.?\s*off$"),
    "ref_designators": (r"ref\s*des", r"^design(ator|ation)s?$", r"^ref(erence)?s?$"),
    "description": (r"^desc", r"description$"),
    "internal_pn": (r"^(internal|house|company|our|customer)\b.*\b(part|pn)", r"^(ipn|cpn|sku)$", r"^material(\s*(number|no))?$", r"^(matnr|idnrk)$"),
    "value": (r"^val(ue)?$",),
    "package": (r"^(pkg|package|footprint|case)", r"package\s*/?\s*case"),
    "tolerance": (r"^tol",),
    "voltage": (r"^v(oltage)?(\s*rating)?$", r"^wvdc$"),
    "power": (r"^(power|wattage)",),
    "alt_mpns": (r"^alt", r"second\s*source", r"^mpn\s*[23456]$", r"(part\s*number|pn)\s*[23456]$", r"^(aml|avl)$"),
    "distributor": (r"^dist", r"^supplier\s*name$"),
    "distributor_pn": (r"(digi\s*-?key|mouser|farnell|newark|element\s*14|arrow|lcsc|rs\s*components?)", r"order\s*code", r"^dist.*\bpn\b"),
    "unit_price_in": (r"^(unit\s*)?(price|cost)", r"(price|cost)\s*(each|/?\s*unit)", r"^rate\b", r"\b(price|cost|rate)\s*\([a-z]{3}\)$"),
    "currency": (r"^(currency|ccy|curr)$",),
    "notes": (r"^(note|remark|comment)",),
    "dnp": (r"^(dnp|dni|dnf)$", r"do\s*not\s*(populate|place|install|fit)", r"^(populate|install|fit(ted)?|loaded?)$"),
    "level": (r"^(bom\s*)?le?ve?l$", r"^indent"),
    "parent": (r"^parent", r"^ass(y|embly)$"),
    "line_id": (r"^(sl|sr|s)\.?\s*no\.?$", r"^line(\s*(no|number|#))?$", r"^(seq|sequence|index)$", r"^#$"),
}
MULTI_FIELDS = ("alt_mpns",)
CONTENT_FIELDS = ("quantity", "unit_price_in", "ref_designators", "currency", "dnp")  # whose cells tell against a header

# What the cells of a column look like
REFDES_CELL = r"^[A-Za-z]{1,4}\d{1,5}([A-Za-z])?([,;/\s]+[A-Za-z]{1,4}\d{1,5}([A-Za-z])?|\s*-\s*[A-Za-z]{0,4}\d{1,5})*$"
MPN_CELL = r"^[A-Za-z0-9][A-Za-z0-9\-_./+#]{2,}$"  # with a digit in it
DNP_CELL = r"(?i)^(dnp|dni|dnf|yes|no|y|n|true|false|1|0|x|populate|do not populate|install|fitted|not fitted|nopop)$"
REFDES_PREFIXES = (
    "R", "C", "L", "U", "D", "Q", "J", "P", "X", "Y", "SW", "S", "F", "K", "T", "TP", "FB", "BT", "MH", "E", "ANT", "IC", "VR", "RN", "CN", "CON", "M", "W", "G", "LED", "Z", "CR", "TR", "XT", "OSC",
    "RL", "RY", "PB", "BAT", "HS", "MP", "MOD", "TB", "FL", "RV", "RT", "ZD", "TVS", "DS",
)
MAKER_HINTS = (
    "TEXASINSTRUMENTS", "TI", "STMICROELECTRONICS", "ST", "MURATA", "TDK", "YAGEO", "VISHAY", "PANASONIC", "KEMET", "SAMSUNG", "NXP", "MICROCHIP", "ANALOGDEVICES", "INFINEON", "ONSEMICONDUCTOR", "ONSEMI",
    "RENESAS", "TECONNECTIVITY", "MOLEX", "AMPHENOL", "BOURNS", "WURTH", "WURTHELEKTRONIK", "NICHICON", "ROHM", "TOSHIBA", "DIODES", "NEXPERIA", "LITTELFUSE", "ABRACON", "EPSON", "COILCRAFT", "OMRON", "AVX",
    "TAIYOYUDEN", "JST", "HIROSE", "BROADCOM", "MICRON", "WINBOND", "ESPRESSIF", "CREE", "OSRAM", "KINGBRIGHT", "HONEYWELL", "BOSCH", "NORDICSEMICONDUCTOR", "XILINX", "LATTICE", "SILICONLABS", "SKYWORKS", "MAXIM",
    "LINEARTECHNOLOGY",
)
SELLER_HINTS = ("DIGIKEY", "MOUSER", "ARROW", "FARNELL", "ELEMENT14", "NEWARK", "RS", "RSCOMPONENTS", "LCSC", "AVNET", "TTI", "FUTURE", "HEILIND", "VERICAL", "ONLINECOMPONENTS", "BUERKLIN", "RUTRONIK")

# Rows: cells that mean nothing, words of a fit column, and header words that turn its sense
PLACEHOLDER_CELLS = (
    "", "-", "--", "---", "n/a", "na", "none", "null", "nil", "tbd", "tba", "?", "??", "x", "xx", "#n/a", "#value!", "#ref!", "0", "no part", "not applicable", "see note", "see notes", "blank", "empty",
)
UNFIT_WORDS = ("NO", "N", "FALSE", "0", "DNP", "DNI", "OMIT", "NOPOP", "NOTFITTED", "UNPOPULATED", "OPEN", "NOTUSED")
FIT_WORDS = ("YES", "Y", "TRUE", "1", "FIT", "FITTED", "POPULATE", "POPULATED", "INSTALL", "INSTALLED", "LOAD", "LOADED", "PLACE", "PLACED", "ASSEMBLE")
FIT_HEADERS = ("POPULATE", "FIT", "FITTED", "INSTALL", "INSTALLED", "LOAD", "LOADED", "ASSEMBLE", "PLACEMENT", "PLACE")
UNFIT_HEADERS = ("DNP", "DNI", "NOT", "NO")
