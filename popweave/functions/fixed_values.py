"""Labels, codes and bounds that results must agree on, in natural order."""

# Marital status codes, civil unions counted with marriages.
MARITAL = {"1": "celibe_nubile", "2": "coniugato_unito", "3": "divorziato_sciolto", "4": "vedovo",
           "15": "coniugato_unito", "16": "vedovo", "17": "divorziato_sciolto"}

# Sex codes.
SEX = {"1": "M", "2": "F", "F": "F", "M": "M"}

# Education labels, tested in this order.
EDUCATION_LADDER = [
    (["its", "primo livello"], "laurea_o_its"),
    (["secondo livello", "dottorato"], "post_laurea"),
    (["nessun", "analfabeta", "alfabeta privo"], "nessun_titolo"),
    (["elementare"], "elementare"),
    (["media inferiore", "avviamento"], "media"),
    (["diploma", "maturit", "secondaria superiore", "qualifica"], "diploma"),
]
EDUCATION_TOTAL = "totale"

# Six education levels to four.
EDUCATION_4 = {"nessun_titolo": "elementare_o_meno", "elementare": "elementare_o_meno", "media": "media",
               "diploma": "diploma", "laurea_o_its": "terziario", "post_laurea": "terziario"}

# Age bands, and the coarse band each belongs to for survey donors.
AGE_BANDS = ["0-8", "9-14", "15-24", "25-34", "35-49", "50-64", "65-74", "75+"]
AGE_MACRO = {"0-8": "0-13", "9-14": "0-13", "15-24": "15-34", "25-34": "15-34", "35-49": "35-54",
             "50-64": "55-64", "65-74": "65+", "75+": "65+"}

# Upper bounds of the fifteen survey age classes.
SURVEY_AGE_UPPER = [2, 5, 10, 13, 15, 17, 19, 24, 34, 44, 54, 59, 64, 74, 200]

# Share of each five-year block that falls in an age band (block number, share, ages).
BAND_BLOCKS = {
    "0-8": [(0, 1.0, 0, 4), (1, 0.8, 5, 8)],
    "9-14": [(1, 0.2, 9, 9), (2, 1.0, 10, 14)],
    "15-24": [(3, 1.0, 15, 19), (4, 1.0, 20, 24)],
    "25-34": [(5, 1.0, 25, 29), (6, 1.0, 30, 34)],
    "35-49": [(7, 1.0, 35, 39), (8, 1.0, 40, 44), (9, 1.0, 45, 49)],
    "50-64": [(10, 1.0, 50, 54), (11, 1.0, 55, 59), (12, 1.0, 60, 64)],
    "65-74": [(13, 1.0, 65, 69), (14, 1.0, 70, 74)],
    "75+": [(15, 1.0, 75, 100)],
}

# Relationship code to household role, and the order of roles in a signature.
ROLES = {1: "R", 2: "P", 3: "P", 4: "G", 5: "G", 6: "F", 7: "F", 8: "A", 9: "A", 10: "A", 11: "A",
         12: "A", 13: "A", 14: "A", 15: "A", 16: "A", 17: "N"}
ROLE_ORDER = "RPFGAN"

# Household conventions.
LARGEST_CENSUS_SIZE = 6
PARTNER_MAX_GAP = 15
PARENT_MIN_GAP, PARENT_MAX_GAP = 20, 40
SAME_SEX_UNIONS = 0.004
MALE_REFERENCE_COUPLE, MALE_REFERENCE_OTHER = 0.8, 0.5
MARRIED, WIDOWED = "coniugato_unito", "vedovo"

# Section ids that stand for people without a place.
SPECIAL_SECTIONS = "888888|999999"

# Codes that mean "total" in a dimension.
TOTAL_CODES = ["ALL", "TOTAL", "TOT", "99", "9", "999", "0", "totale", "total"]

# Activity-status aggregates and the detail that makes them redundant.
STATUS_AGGREGATES = ["99", "ALL"]
LABOUR_FORCE, LABOUR_FORCE_DETAIL = "22", ["1", "12"]
NON_LABOUR, NON_LABOUR_DETAIL = "23", ["4", "5", "7", "24"]

# Tokens for missing answers and for undefined cell keys.
NOT_APPLICABLE = "non_applicabile"
UNDEFINED_CELL = "__nd__"

# Entries a source record must not leave open.
PLACEHOLDERS = ["DA_VERIFICARE", "DA_COMPILARE", "DA_CALCOLARE", "DA_REGISTRARE", "?", ""]

# Accented Latin letters and their base letters.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÑÇāēīōūšžčćńśźżłđğşăęąėťďňřěů"
BASE = "aaaaaaeeeeiiiiooooouuuuyyncAAAAAAEEEEIIIIOOOOOUUUUYNCaeiouszccnszzldgsaeaetdnreu"
