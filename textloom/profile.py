"""Language and domain constants, so that the operators themselves have none."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    """What the text operators need to know about a language and a kind of document."""

    lower: bool = False
    #: 1:1 letter folds and letters to delete, applied before matching (never to stored text).
    fold_from: str = ""
    fold_to: str = ""
    deleted: str = ""
    digits: str = "0123456789"
    in_force: str = "in-force"
    repealed: str = "repealed"
    marker_line: str = r"^\s*[0-9]{1,4}\s*$"
    #: Groups: 1 first number, 2 last number of a range.
    reference: str = r"(?i)(?:articles?|section)\s*[-–—]?\s*([0-9]{1,4})(?:\s*[-–—]\s*([0-9]{1,4}))?"
    #: Look-behind shorthand of one reference; group 1 is the number.
    shorthand: str = r"(?i)(?<![^\s])art\.?\s*([0-9]{1,4})(?![0-9])"
    #: Groups: 1 number, 2 letter, 3 "bis".
    header: str = r"(?i)^[ \t]*(?:article|section)[ \t]*[-–—]?[ \t]*([0-9]{1,4})(?:[ \t]*([A-Za-z]))?(?:[ \t]*(bis))?[ \t]*$"
    bis: str = "bis"
    #: Groups: 1 number, 2 year.
    citation: str = r"(?i)\bno\.?\s*\(?\s*([0-9]+)\s*\)?\s*(?:of|/)\s*([0-9]{2,4})"
    year_tail: str = r"(?i)(?:of|/)\s*[0-9]{2,4}\s*$"
    kinds: tuple[str, ...] = ("regulation", "decree", "notice", "decision", "law")
    phrase_kinds: tuple[str, ...] = ("law", "regulation", "instructions")
    title_kinds: tuple[str, ...] = ("law", "regulation", "instructions", "decision", "notice")
    fillers: tuple[str, ...] = ("by", "in", "of", "on", "and")
    according: str = "under"
    overview_cues: tuple[str, ...] = ("what is", "define")
    overview_stops: tuple[str, ...] = ("in", "of", "on", "by", "under", "and", "or", "this", "that", "law", "the")
    analytical_cues: tuple[str, ...] = ("what ", "how", "when", "why", "explain", "compare", "penalty")
    question_prefixes: tuple[str, ...] = ("what is", "define", "explain")
    generic_needles: tuple[str, ...] = ("the law",)
    stop_words: tuple[str, ...] = ("what", "is", "the", "a", "an", "of", "for", "and", "or", "to", "in", "on", "how", "when", "where")
    comparative: tuple[str, ...] = ("difference between", "compare", "versus", " vs ")
    draft_cues: tuple[str, ...] = ("draft", "template")
    repeal_cues: tuple[str, ...] = ("repealed by", "replaced by")
    generic_cores: tuple[str, ...] = ("law", "regulation")
    word_chars: str = r"\p{L}"
    amendment_markers: tuple[str, ...] = ("amendment", "notice", "decision")
    base_codes: tuple[str, ...] = ("penal code", "labour code", "civil code")
    title_penalties: tuple[tuple[str, float], ...] = (("amendment", 38.0), ("annex", 42.0), ("military", 48.0))
    alias_suffix: str = r"\s+(of the republic)\s*$"
    min_core: int = 8
    #: Words of a question, words of a title, whether the title must begin with one, points: a seed's title that fits the question's kind.
    seed_boosts: tuple[tuple[tuple[str, ...], tuple[str, ...], bool, float], ...] = ((("law",), ("law",), True, 25.0), (("regulation",), ("regulation",), False, 25.0))
    #: A needle with this word, or of this length, is exact.
    number_word: str = "no"
    #: Titles of lesser acts, and the words of a question or phrase that ask for them.
    lesser_titles: tuple[str, ...] = ("correction notice", "instructions", "decision")
    lesser_asked: tuple[str, ...] = ("instructions", "decision", "notice")
    #: How normalised words may stand in stored text: (ending, its other form) and (letter, what it may be everywhere).
    ending_variants: tuple[tuple[str, str], ...] = ()
    letter_variants: tuple[tuple[str, str], ...] = ()
    extra: dict = field(default_factory=dict)


#: Fixed values of Arabic legislation: letters, digits, words and patterns that results depend on.
LEGAL_AR = Profile(
    fold_from="آأإٱىة",
    fold_to="اااايه",
    deleted="ًٌٍَُِّْـ",
    digits="٠١٢٣٤٥٦٧٨٩",
    in_force="نافذ",
    repealed="ملغى",
    marker_line=r"^\s*[٠-٩0-9]{1,4}\s*$",
    reference=r"(?:المادة|المادتين|المادتان|المواد|ماد[ةه])\s*[-–—]?\s*([٠-٩0-9]{1,4})(?:\s*[-–—]\s*([٠-٩0-9]{1,4}))?",
    shorthand=r"(?<![^\s])م\s*[-–—]?\s*([٠-٩0-9]{1,4})(?![٠-٩0-9])",
    header=r"^[ \t]*(?:المادة|ماد[ةه])[ \t]*[-–—]?[ \t]*([٠-٩0-9]{1,4})(?:[ \t]*([أ-يA-Za-z]))?(?:[ \t]*(مكرر))?[ \t]*$",
    bis="مكرر",
    citation=r"(?i)رقم\s*\(?\s*([٠-٩0-9]+)\s*\)?\s*(?:لسنة|/)\s*([٠-٩0-9]{2,4})",
    year_tail=r"(?:لسنة|/)\s*[٠-٩0-9]{2,4}\s*$",
    kinds=("تعليمات", "نظام", "مرسوم", "بيان", "قرار", "قانون"),
    phrase_kinds=("قانون", "نظام", "تعليمات"),
    title_kinds=("قانون", "نظام", "تعليمات", "قرار", "بيان"),
    fillers=("حسب", "في", "من", "علي", "و"),
    according="حسب",
    overview_cues=("ما هو", "ما هي", "ما المقصود", "عرف", "ما تعريف", "what is", "define"),
    overview_stops=("في", "من", "علي", "حسب", "وفق", "بموجب", "و", "او", "ان", "هذا", "هذه", "ذلك", "قانون", "نظام", "ال"),
    analytical_cues=("ما ", "ماهي", "ما هي", "كيف", "متي", "هل ", "لماذا", "لم ", "عقوبه", "احكام", "شرح", "فسر", "وضح", "قارن", "الفرق"),
    question_prefixes=("ما هو", "ما هي", "ما المقصود ب", "ما المقصود", "ما احكام", "احكام", "عرف", "اشرح", "وضح", "هل يجوز", "هل يمكن"),
    generic_needles=("القانون", "النظام", "العراقي", "العراق"),
    stop_words=(
        "ما", "هي", "هو", "في", "من", "على", "علي", "الى", "الي", "عن", "هل", "يجوز", "يمكن", "حسب", "وفق", "بموجب", "و", "او",
        "هذا", "هذه", "ذلك", "تلك", "التي", "الذي", "ان", "كان", "يكون", "بين", "مع", "كل", "اي", "لا", "لم", "لن", "قد", "عند",
        "بعد", "قبل", "غير", "فقط", "بناء", "قانون", "نظام", "تعليمات", "قرار", "بيان", "المادة", "المواد", "الاحكام", "احكام",
        "بشان", "بخصوص", "what", "is", "the", "a", "an", "of", "for", "and", "or", "to", "in", "on", "how", "when", "where",
    ),
    comparative=("الفرق بين", "مقارنة", "قارن بين", "versus", " vs "),
    draft_cues=("صيغة", "عريضة", "نموذج", "مسودة", "draft", "template"),
    repeal_cues=("الغي بموجب", "ألغي بموجب", "أُلغي بموجب", "ملغى بموجب", "يحل محل", "يستعاض عنه", "يستعاض عن"),
    generic_cores=("قانون", "نظام", "تعليمات", "بيان", "قرار", "مرسوم", "ارادة", "قانون تعديل", "نظام تعديل", "تعليمات تعديل"),
    word_chars=r"[ء-يٱپچژڤگ]",
    amendment_markers=("تعديل", "بيان", "قرار", "تصديق", "الغاء", "ذيل", "تفسير"),
    base_codes=("قانون العقوبات", "قانون الاحوال الشخصية", "قانون العمل", "القانون المدني", "قانون المرافعات المدنية", "قانون اصول المحاكمات الجزائية", "قانون الشركات", "قانون المواريث", "قانون التجارة", "قانون الخدمة المدنية"),
    title_penalties=(
        ("عسكري", 48.0), ("ذيل", 42.0), ("ذيول", 42.0), ("تعديل", 38.0), ("سريان", 40.0), ("نفاذ قانون", 40.0), ("لانفاذ", 45.0), ("انفاذ قانون", 40.0),
        ("للاجانب", 40.0), ("تصديق", 32.0), ("اتفاقية التعاون", 30.0), ("بيان -", 28.0), ("اعادة العمل", 36.0), ("امر سلطة", 40.0), ("ائتلاف", 40.0),
    ),
    seed_boosts=((("قانون",), ("قانون",), True, 25.0), (("نظام",), ("نظام",), False, 25.0), (("جامعة", "جامعات", "كلية", "كليات", "عالي"), ("عالي", "جامعة", "جامعات", "كلية"), False, 18.0)),
    number_word="رقم",
    lesser_titles=("بيان تصحيح", "تعليمات", "قرار"),
    lesser_asked=("تعليمات", "قرار", "بيان"),
    alias_suffix=r"\s+(العراقي|لجمهورية العراق|جمهورية العراق)\s*$",
    ending_variants=(("ه", "ة"), ("ة", "ه")),
    letter_variants=(("ي", "ى"), ("ى", "ي")),
)
GENERIC = Profile(lower=True)
