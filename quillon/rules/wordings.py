"""Wordings that descriptions are brought to, as lists of spellings.

A family maps a standard word to the spellings that become it; the rules that do so are made
from the lists (:func:`quillon.functions.rewrite.shipped_rules`).  Families apply in order.
``PATTERNS`` holds the few rewritings that are no word for a word; they say ``(pattern, replacement)``.
"""

# Abbreviations of the field and what they stand for; standard forms depend on them.
QUADRANTS = {
    "RUQ": ("RIGHT UPPER QUADRANT", "R U Q"),
    "RLQ": ("RIGHT LOWER QUADRANT", "R L Q"),
    "LUQ": ("LEFT UPPER QUADRANT", "L U Q"),
    "LLQ": ("LEFT LOWER QUADRANT", "L L Q"),
}
STUDIES = {
    "CT ABDOMEN PELVIS": ("CTAP",),
    "CT CHEST ABDOMEN PELVIS": ("CTCAP",),
    "CT PULMONARY ANGIOGRAM": ("CTPA",),
    "CT ANGIOGRAM": ("CTA",),
    "CT VENOGRAM": ("CTV",),
    "MR ANGIOGRAM": ("MRA",),
    "MR VENOGRAM": ("MRV",),
    "CHEST XR": ("CXR",),
    "CARDIAC PERFUSION": ("CARDIOLITE", "MYOVIEW", "SESTAMIBI", "THALLIUM"),
    "HEPATOBILIARY": ("DISIDA", "HIDA"),
    "BIOPHYSICAL PROFILE": ("BPP",),
    "MODIFIED BARIUM SWALLOW": ("MBS",),
}
EXTREMITIES = {
    "UPPER EXTREMITY": ("UE", "UP EXT", "UPPER EXT", "UPPER EXTREM", "UPPER EXTREMITIES"),
    "LOWER EXTREMITY": ("LE", "LOW EXT", "LOWER EXT", "LOWER EXTREM", "LOWER EXTREMITIES"),
    "EXTREMITY": ("EX", "EXT", "EXTREMITIES"),
}
PARTS = {
    "ABDOMEN": ("ABD", "ABDO", "ABDOMIN", "ABDOMINAL"),
    "PELVIS": ("PEL", "PLVS"),
    "CHEST": ("THORAX",),
    "HEART": ("HRT",),
    "GALLBLADDER": ("GB",),
    "BILIARY": ("CBD",),
    "BONE": ("BN",),
    "JOINT": ("JT", "JTS"),
    "TIBIA": ("TIB",),
    "FIBULA": ("FIB",),
    "CALCANEUS": ("CALCIS", "HEEL"),
    "ORBITS": ("ORBIT",),
    "UMBILICAL": ("UMB",),
    "ZYGOMATIC": ("ZYGOMA",),
    "TEMPOROMANDIBULAR": ("TMJ", "TMJS"),
    "STERNOCLAVICULAR": ("STERNOCLAV",),
    "SACROILIAC": ("SACRO ILIAC",),
    "SACROILIAC JOINT": ("SI JOINT", "SI JOINTS"),
    "UGI": ("UPPER GI",),
}
SPINES = {
    "CERVICAL SPINE": ("C SPINE", "CERV", "CERV SPINE", "CERVICAL", "SPINE CERVICAL"),
    "THORACIC SPINE": ("T SPINE", "THORA", "THORA SPINE", "THORACIC", "SPINE THORACIC"),
    "LUMBAR SPINE": ("L SPINE", "LS SPINE", "LUMBAR", "LUMBER", "LUMBER SPINE", "LUMBO SACRAL", "LUMBOSACRAL", "LUMBOSACRAL SPINE", "SPINE LUMBAR"),
    "SPINE": ("SCOLIOSIS",),
}
WORDS = {
    "COMPLETE": ("COMP", "COMPL"),
    "LIMITED": ("LTD",),
    "MODIFIED": ("MOD",),
    "ADDITIONAL": ("ADDL",),
    "DIAGNOSTIC": ("DIAG",),
    "CHECK": ("CK",),
    "PROVIDER": ("PROV",),
    "EXPIRATION": ("EXP",),
    "NO": ("NON", "OTHER THAN"),
    "TWIN": ("TWINS",),
    "WEEKS": ("WKS",),
    "TRIMESTER": ("TRI", "TRIMEST"),
    "GESTATION": ("GE", "GES", "GEST"),
    "TRANSVAGINAL": ("TRANSVAG", "TV"),
    "TRANSABDOMINAL": ("TA", "TRANS ABD", "TRANSABD"),
}
METHODS = {
    "MR": ("MRI",),
    "US": ("SONO", "SONOGRAM", "ULTRASOUND"),
    "PET": ("PT",),
    "XR": ("DX", "FC"),
    "MG": ("MAMMO DIGITAL", "MAMMO", "MAMMOGRAM", "MAMMOGRAPHY", "MM"),
    "BMD": ("BD", "BONE DENSITY"),
    "DEXA": ("DXA",),
    "FLUOROSCOPY": ("FLUORO",),
    "ANGIOGRAM": ("ANGIO", "ANGIOGRAPHY"),
    "ARTHROGRAM": ("ARTHOGRAPHY", "INTRA ARTICULAR", "INTRAARTICULAR"),
    "MYELOGRAM": ("MYELOGRAPHY",),
    "CYSTOGRAM": ("CYSTOGRAPHY",),
    "DOPPLER": ("DOPP",),
    "DECUBITUS": ("DECUB",),
    "LORDOTIC": ("LORD", "LR"),
}
TREATMENTS = {
    "BIOPSY": ("BX",),
    "FINE NEEDLE ASPIRATION": ("FNA",),
    "INJECTION": ("INJ",),
    "LOCALIZATION": ("LOC",),
    "RECONSTRUCTION": ("RECONST",),
    "CATHETER": ("CATH",),
    "CANCER": ("CA",),
    "VEINS": ("VENOUS",),
    "ARTERIAL": ("ARTERIES",),
    "BARIUM": ("BARI",),
    "CENTRAL VEINS CATHETER": ("CVC",),
    "PICC": ("PICC LINE",),
    "NEPHROSTOMY": ("NEPHROSTOGRAM", "NEPHROSTOMY CATHETER"),
    "GASTROSTOMY TUBE": ("G TUBE",),
    "JEJUNOSTOMY TUBE": ("J TUBE",),
    "GASTROSTOMY JEJUNOSTOMY TUBE": ("GJ TUBE",),
    "T TUBE": ("TTB",),
    "TUBE REPLACEMENT": ("TUBE CHANGE",),
    "DRAINAGE ABSCESS": ("ABSCESS DRAIN",),
    "PORT": ("CHEST PORT",),
    "PORT REMOVE": ("PORT REMOVAL",),
    "FISTULA STUDY": ("FISTULAGRAM",),
    "FISTULA DIALYSIS": ("DIALYSIS FISTULA",),
    "DIAPHRAGM FLUOROSCOPY": ("SNIFF TEST", "FL SNIFF TEST"),
    "FLUOROSCOPY INTRAOPERATIVE": ("FL OR BRAINLAB", "FL OR"),
}
VIEWS = {"VIEW": ("V", "VI", "VIEWS", "VS", "VW", "VWS"), "MINIMUM": ("MIN",)}
SIDES = {"LEFT": ("L", "LT"), "RIGHT": ("R", "RT"), "BILATERAL": ("BI", "BIL", "BILA", "BILAT"), "UNILATERAL": ("UNI", "UNIL", "UNILAT")}

# Rewritings of our own that are no word for a word.
PATTERNS = {
    # "w", "wo" and their joined forms; RUNOFF and the like are shown with the study, not with contrast
    "contrast": (
        (r"\bW/?\s*(RUNOFF|LEGS?|LOWER\s+EXTREM\w*|LONG\s+LEG)\b", r"INCLUDING \1"),
        (r"_", " "),
        (r"\bWWOC\b", "WITH AND WITHOUT CONTRAST"),
        (r"\bW(?:ITH)?/?\s*(?:AND\b|[-+&/\\])?\s*W(?:/?O|ITHOUT)\b", "WITH AND WITHOUT"),
        (r"\b(?:W/?O|WITHOUT)\s*(?:AND\b|[-+&/\\])?\s*W(?:ITH)?\b(?!/)", "WITH AND WITHOUT"),
        (r"\b(?:WOC|CON\s*W/O|NO\s+(?:IV|DYE|CNTR|CO(?:N|NT|NTR|NTRAST)?))\b", "WITHOUT CONTRAST"),
        (r"\bW/?O\b", "WITHOUT"),
        (r"\b(?:WC\b|CON\s*W/(?![^\s]))", "WITH CONTRAST"),
        (r"\bW(?:/|\b)", "WITH "),
        (r"\b(?:IV\b|DYE\b|CNTR\b|CO(?:N(?:T(?:R(?:A(?:ST?)?)?)?)?)?(?![^\s]))", "CONTRAST"),
        (r"\bCONTRAST(?:\s+CONTRAST)+\b", "CONTRAST"),
    ),
    "breast": ((r"\bDX\b", "DIAGNOSTIC"), (r"\b(?:3\s*[-/]?\s*D|TOMO)\b", "TOMOSYNTHESIS")),
    # words that are written with a mark inside, before marks go
    "marks": (
        (r"\bNON-OB\b", " "),
        (r"\b(?:ABD/PEL(?:VIS)?|A\s*/\s*P)\b", "ABDOMEN PELVIS"),
        (r"\bTIB(?:IA)?/FIB(?:IA|ULA)?\b", "TIBIA FIBULA"),
        (r"\bFL\s+ASP/INJ\b", "FLUOROSCOPY ASPIRATION INJECTION"),
        (r"\bB/L\b", "BILATERAL"),
        (r"\b(ADD|BAKER)'([LS])\b", r"\1\2"),
        (r"\bX[-\s]?RAYS?\b", "XR"),
        (r"#AP|&", " AND "),
        (r"\+", " PLUS "),
        (r"[^\w\s>.%]", " "),
        (r"(\d)(V\w*)", r"\1 \2"),
        (r"(\d)(MIN)\b|\bMIN(\d)", r"\1 MIN \3"),
        (r"\b3TRI\b", "3 TRI"),
    ),
    "leave out": ((r"\b(?:CLINIC|DNU|OR\s+MORE)\b", " "),),
    "interventions": (
        (r"\bIR\s+(ABSCESS|CHEST|CVC|DRAIN\w*|EMBOLIZATION|GJ|KYPHOPLASTY|NEPHROSTOMY|PERICARDI\w*|PICC|PORT|STENT\w*|TRANSJUGULAR\w*|TUBE|VERTEBROPLASTY)\b", r"\1"),
        (r"\bURETERAL\s+STENT\b", "URETERAL CATHETER STENT"),
        (r"(?<!CATHETER )\bSTENT\s+PLACEMENT\b", "CATHETER PLACEMENT STENT"),
        (r"\bFL\s+(INJECTION|REPOSITION)(?:ING)?\b", r"FLUOROSCOPY \1"),
    ),
}

#: What applies to every text, in order: lists of spellings, and names of ``PATTERNS``.
ORDER = (QUADRANTS, "marks", EXTREMITIES, "leave out", STUDIES, WORDS, PARTS, SPINES, METHODS, TREATMENTS, "interventions", VIEWS, SIDES)

# Organs and the regions whose words they add to a description, in our own choice.
ORGANS = {
    "RUQ": ("GALLBLADDER", "HEPATIC", "HEPATOBILIARY", "LIVER"),
    "ABDOMEN": ("ADRENAL", "APPENDIX", "BOWEL", "GALLBLADDER", "HEPATIC", "HEPATOBILIARY", "KIDNEY", "LIVER", "PANCREAS", "RENAL", "SPLEEN", "STOMACH", "URETER"),
    "PELVIS": ("ADNEXA", "APPENDIX", "BLADDER", "ENDOMETRIUM", "OVARIAN", "OVARIES", "OVARY", "PROSTATE", "UTERINE", "UTERUS"),
    "NECK": ("CAROTID", "JUGULAR", "LARYNX", "PARATHYROID", "THYROID"),
    "HEAD": ("EYE", "MASTOID", "ORBITS", "PITUITARY", "SELLA", "TEMPORAL"),
    "FACE": ("MANDIBLE", "MAXILLA", "NASAL", "SINUS", "SINUSES", "ZYGOMATIC"),
    "SINUSES": ("PARANASAL", "SINUS"),
    "HEART": ("CARDIAC", "MYOCARDIAL", "MYOCARDIUM"),
    "CHEST": ("CARDIAC", "LUNG", "MYOCARDIAL", "PULMONARY"),
    "LOWER EXTREMITY": ("RUNOFF",),
    "ESOPHAGUS": ("ESOPHAGRAM", "SWALLOW"),
}

# Other ways to say a word of a description, in our own choice: at its start, and anywhere.
OPENINGS = {
    r"(CT|MR) (\w+) Angio": (r"\1A \2",),
    "BMD": ("Bone density",), "CT": ("CT scan",), "FL": ("Fluoroscopy",), "MG": ("Mammogram",), "MR": ("MRI",), "NM": ("Nuclear medicine",),
    "PT": ("PET",), "US": ("Ultrasound", "Sonogram"), "XA": ("Angiogram",), "XR": ("X-Ray", "Radiograph"),
}
SYNONYMS = {
    "w and wo IV Contrast": ("with and without contrast", "w/wo"),
    "wo IV Contrast": ("without contrast", "w/o"),
    "w IV Contrast": ("with contrast",),
    "Abdomen": ("Abd", "Abdominal"), "Bilateral": ("Bilat", "Both"), "Brain": ("Head",), "Cervical Spine": ("C-spine",), "Chest": ("Thorax",), "Extremity": ("Ext",),
    "Head": ("Brain",), "Heart": ("Cardiac",), "Kidney": ("Renal",), "Left": ("LT", "L"), "Liver": ("Hepatic",), "Lumbar Spine": ("L-spine",), "Lung": ("Pulmonary",),
    "Pelvis": ("Pelvic",), "Right": ("RT", "R"), "Thoracic Spine": ("T-spine",), r"(\d+) Views?": (r"\1V", r"\1 view"),
}
