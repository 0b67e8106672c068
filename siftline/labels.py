"""The labels that appear in results. They must equal the expected output text."""

UNKNOWN_PLACE = "לא ידוע / דורש אימות"
UNKNOWN_DATE = "תאריך לא ידוע / דורש אימות"
UNKNOWN_COMPANY = "לא צוין במקור"

# outcomes of the cascade
ACCEPTED = "נשלפה"
TITLE_NOT_RELEVANT = "כותרת לא רלוונטית"
NO_DESCRIPTION = "תיאור משרה מלא לא זמין"
NO_KEYWORD = "אין מילת מפתח בתיאור"
TOO_OLD = "ישנה מ-20 ימים"
DUPLICATE = "כפילות בהרצה"
PLACE_PREFIX = "מיקום: "
KEYWORDS_PREFIX = "; מילות מפתח בתיאור: "
DATE_UNKNOWN_SUFFIX = "; תאריך לא ידוע"

# role essence
ESSENCE_EXCLUDED = "תפקיד החרגה לפי הכותרת"
ESSENCE_COMBINED_OK = "כותרת משולבת - עיקר העבודה אנליטי"
ESSENCE_COMBINED_NO = "כותרת משולבת - עיקר העבודה פיתוח/הנדסה"
ESSENCE_LISTED_OK = "כותרת תואמת"
ESSENCE_LISTED_NO = "עיקר התפקיד הנדסי למרות הכותרת"
ESSENCE_VARIANT_OK = "וריאציה של כותרת אנליטית"
ESSENCE_VARIANT_NO = "וריאציה אנליטית ללא מהות אנליטית מספקת בתיאור"
ESSENCE_CANDIDATE_OK = "כותרת לא סטנדרטית - מהות התפקיד Data Analytics"
ESSENCE_CANDIDATE_NO = "כותרת לא סטנדרטית ללא מהות אנליטית מרכזית"

# place notes
PLACE_ABROAD = "מחוץ לישראל"
PLACE_NOT_HOME = "מיקום לא ישראלי"
PLACE_CONTEXT_ABROAD = "הקשר מצביע על חו\"ל"
PLACE_INFERRED = "ישראל הוסקה מההקשר"
PLACE_TITLE_ABROAD = "הכותרת מציינת מיקום מחוץ לישראל"
HOME_NAME_LOCAL = "ישראל"

# link status
OK = "הצלחה"
FAILED = "נכשל"
PARTIAL = "חלקי"
UNREACHABLE = "לא נגיש"
NOT_SCANNED = "לא נסרק - הסתיים זמן הסריקה"
TIME_OVER = "הסריקה נעצרה - הגיע מועד סיום הסריקה"
PAGES_NOT_LOADED = "עמודי משרה לא נטענו"
PAGE_WITHOUT_TEXT = "עמוד משרה ללא תיאור"
NO_RELEVANT_NOW = "אין בעמוד משרות רלוונטיות כרגע"
NOT_READABLE = "לא נמצאו משרות בעמוד - העמוד נטען ב-JavaScript ואין בו מערכת גיוס מוכרת"
STOPPED_AT_PAGE = "עצירה בעמוד"
DISCOVERY_SITES = ("Bing", "גילוי")

# company sectors, in report order
HITECH = "הייטק"
BANKS = "בנקים"
FINANCE = "ביטוח ופיננסים"
CONSULTING = "ייעוץ ושירותי IT"
HEALTH = "בריאות ופארמה"
MEDIA = "תקשורת ומדיה"
RETAIL = "קמעונאות ומוצרי צריכה"
INDUSTRY = "תעשייה ביטחון ואנרגיה"
OTHER = "אחר"
AGENCY = "חברת השמה / חסוי"
SECTOR_ORDER = (HITECH, BANKS, FINANCE, CONSULTING, HEALTH, MEDIA, RETAIL, INDUSTRY, OTHER, AGENCY)
STRENGTH = {"override": 6, "hidden": 5, "name": 4, "industry": 3, "ats": 2, "description": 1, "none": 0}

# excluded regions
REGION_REHOVOT = "רחובות / Rehovot"
REGION_RISHON = "ראשון לציון / Rishon LeZion"
REGION_JERUSALEM = "ירושלים / Jerusalem"
REGION_NORTH = "אזור הצפון / North"
REGION_SOUTH = "אזור הדרום / South"

# report tables
TABLES = {"new": "משרות חדשות", "cumulative": "רשימה מצטברת",
          "sources": "מצב המקורות", "sites": "מקורות ייחודיים"}
