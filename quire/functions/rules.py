"""Word lists, patterns and thresholds that results depend on.

Patterns are Java regular expressions without look-around unless noted, so that RE2 reads them too.
"""

# line terminators of str.splitlines
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"

# languages: code, Portuguese name, aliases
LANGUAGES = (
    ("en", "inglês", ("english", "ingles")),
    ("ja", "japonês", ("japanese", "japones", "jp")),
    ("ko", "coreano", ("korean", "kr")),
    ("zh", "chinês", ("chinese", "chines", "mandarin", "cn", "zh-cn", "zh-tw")),
    ("es", "espanhol", ("spanish", "espanol")),
    ("fr", "francês", ("french", "frances")),
    ("de", "alemão", ("german", "alemao")),
    ("it", "italiano", ("italian",)),
    ("ru", "russo", ("russian",)),
    ("ar", "árabe", ("arabic", "arabe")),
    ("pl", "polonês", ("polish", "polones")),
    ("nl", "holandês", ("dutch", "holandes")),
    ("tr", "turco", ("turkish",)),
    ("id", "indonésio", ("indonesian", "indonesio")),
    ("vi", "vietnamita", ("vietnamese",)),
    ("th", "tailandês", ("thai", "tailandes")),
)
# scripts that decide a language, in this order
SCRIPT_LANGUAGES = (
    ("ja", "[ぁ-ゖァ-ヺ]"),
    ("ko", "[가-힣ㄱ-ㅎㅏ-ㅣ]"),
    ("th", "[฀-๿]"),
    ("ar", "[؀-ۿ]"),
    ("ru", "[Ѐ-ӿ]"),
    ("zh", "[㐀-䶿一-鿿]"),
)
LANGUAGE_SAMPLE = 50_000
# frequent words, in order of preference on ties
LANGUAGE_MARKERS = (
    ("en", "the and that with from this was were have"),
    ("es", "el los las una que con para pero como estaba"),
    ("fr", "le les une des que avec pour mais dans était"),
    ("de", "der die das und mit für nicht aber war ist"),
    ("it", "il gli una che con per non ma era sono"),
    ("pl", "się nie jest jak ale dla przez jego jej był"),
    ("nl", "het een van met voor niet maar was zijn dat"),
    ("tr", "bir ve ile için değil ama bu olan olarak daha"),
    ("id", "yang dan dengan untuk tidak tetapi ini itu dari ada"),
    ("vi", "và của một không nhưng cho với đã được trong"),
)
LANGUAGE_LEAST_HITS = 2

# residue of the source language in a translation
RESIDUAL_SCRIPTS = (
    ("ja", "[ぁ-ゖァ-ヺ]+|[一-龯々〆ヵヶ]{2,}"),
    ("ko", "[가-힣ㄱ-ㅎㅏ-ㅣ]{2,}"),
    ("zh", "[㐀-䶿一-鿿]{2,}"),
    ("ru", "[Ѐ-ӿ]{3,}"),
    ("ar", "[؀-ۿ]{3,}"),
    ("th", "[฀-๿]{3,}"),
)
RESIDUAL_WORDS = (
    ("es", "el los las una con para pero estaba"),
    ("fr", "le les une des avec pour mais était"),
    ("de", "der die das und mit für nicht aber"),
    ("it", "il gli che con per non sono della"),
    ("pl", "się nie jest ale przez jego był była"),
    ("nl", "het een van met voor niet maar zijn"),
    ("tr", "bir ve ile için değil ama olan daha"),
    ("id", "yang dan dengan untuk tidak tetapi dari ada"),
    ("vi", "và của một không nhưng cho với được"),
)
ENGLISH_WORDS = (
    "about after again against all also although always among another around asked because before behind believe between brought called "
    "calmly came choose choosing could desire directly does doesn't doing done enough every everyone everything felt from gave gives going "
    "gone have haven't having however into itself knew know knowing made make makes might must neither never nothing once only other perhaps "
    "replied said says should something still strongly such than that their theirs them themselves then there these they they're this those "
    "though through told toward under until upon wanted wasn't were weren't what whatever when where whether which while who whom whose with "
    "within without would wouldn't your you're yours"
).split()
PORTUGUESE_WORDS = (
    "agora ainda alguém algum alguma alguns algumas antes aqui assim até caso com como da das de dela dele deles depois do dos ela elas ele "
    "eles em então era essa esse isso mais mas mesmo minha muito na não nas nem no nos para pela pelo por porque quando que quem sem seu sua "
    "talvez também tinha uma você vocês"
).split()
ENGLISH_CONTRACTIONS = r"\b(?:i['’]m|i['’]ll|i['’]ve|you['’]re|you['’]ll|they['’]re|we['’]re|it['’]s|that['’]s|can['’]t|won['’]t|don['’]t|doesn['’]t|didn['’]t|wouldn['’]t|shouldn['’]t|couldn['’]t|haven['’]t|weren['’]t|wasn['’]t)\b"
ENGLISH_POSSESSIVE = r"\b[A-Z][A-Za-z]+['’]s\b"
ENGLISH_TOKENS = ("af", "arright", "boost", "buff", "buffs", "kys", "selves", "they", "though", "uh", "uhh")
ENGLISH_PHRASES = ("i see",)

# noise
ZERO_WIDTH = r"[\x{200b}\x{200c}\x{200d}\x{feff}]"
URL = r"(?:https?://|www\.)\S+|\b(?:[a-z0-9-]+\.)+[a-z]{2,63}(?:[/?#]\S*)?"
PROMO_PHRASES = ("thank you for reading", "thank you for downloading", "get the latest news")
PROMO_LINES = (
    r"^\s*sign up for\b.*\b(?:newsletter|updates?|email|inbox|account|free|alerts?)\b",
    r"^\s*sign up for our\s*[!.:]?$",
    r"^\s*read online\b",
    r"^\s*read (?:more|the latest) on\b",
    r"^\s*download(?:ing)?\b.*\b(?:mobile app|favorite light novels|light novels|pdf|e-?books?|app)\b",
    r"^\s*join our\b.*\b(?:community|server)\b",
    r"^\s*follow us\b.*\b(?:online|social media|updates?)\b",
    r"^\s*support (?:us|our work)\b.*\b(?:donat|membership|website|site|online)\b",
    r"^\s*(?:or\s+)?visit us online\b",
)
FOOTERS = (r"\bPage\s+\d+\b", "newsletter", "stay up to date", "download(?:ing)? our mobile app", "download all your favorite light novels", "favorite light novels", r"(?:or\s+)?visit us online")
NOISE_PARAGRAPHS = (
    r"stay up to date",
    r"download(?:ing)? our mobile app",
    r"^\s*join our\b.*\b(?:community|server)\b",
    r"newsletter",
    r"^\s*follow us\b.*\b(?:online|social media|updates?)\b",
    r"^\s*support (?:us|our work)\b.*\b(?:donat|membership|website|site|online)\b",
    r"^\s*read (more|the latest) on\b",
    r"get the latest news",
    r"^\s*(?:or\s+)?visit us online\b",
)
TOC_MARKERS = ("table of contents", "sumário", "índice", "indice", "índice remissivo", "color inserts", "inserções coloridas", "title page", "página de título", "copyrights and credits", "newsletter")
SECTION_WORDS = "prologue|pr[oó]logo|prolog|序章|前言|プロローグ|프롤로그|epilogue|ep[ií]logo|epilog|終章|终章|エピローグ|에필로그|afterword|posf[aá]cio|p[oó]s[- ]?escrito|あとがき|後書き|后记|後記|후기"
SECTION = (
    r"(?i)^(?:" + SECTION_WORDS + r"|(?:chapter|cap[ií]tulo|chapitre|kapitel|capitolo|glava|глава)\s+(?:\d+|[一二三四五六七八九十百零〇]+)(?:(?::|\s*[–—-])\s*[^\n]*)?"
    r"|第\s*(?:\d+|[一二三四五六七八九十百零〇]+)\s*[章話话巻卷](?:\s*[:：–—-]?\s*[^\n]+)?|제\s*(?:\d+|[일이삼사오육칠팔구십백]+)\s*장(?:\s*[:：–—-]?\s*[^\n]+)?)\s*$"
)
QUOTE_OR_DASH_START = "^\\s*[\"“'’\\-–—]"
ELLIPSIS_LINE = "^[\"“”']?(?:…|\\.{3,})[\"“”']?$"
REPEAT_FREQUENCY, REPEAT_LENGTH = 6, 80
MOJIBAKE = ("ÔÇ£", "ÔÇ\u0098", "ÔÇª", "Ã¢€", "├", "├Ç", "├Ñ")

# model output
META_TRANSLATE = (
    r"as an ai language model",
    r"i am an ai",
    r"\bi cannot\b",
    r"\bi can't\b",
    r"como um modelo de linguagem",
    r"eu sou apenas",
    r"^\s*sorry[,:]?\s+(but\s+)?i (can't|cannot)\b",
    r"^\s*desculp\w*[,:]?\s+(mas\s+)?(n[aã]o posso|n[aã]o consigo|eu n[aã]o)\b",
)
META_NOISE = ("as an ai", "<think>", "</think>", "sou um modelo de linguagem", "analysis:")
FOREIGN_PHRASES = ("mon ami", "bonjour", "ma ch", "très", "siempre")
COMMON_ENGLISH = ("the", "and", "with", "from", "this", "that", "here", "there", "you", "your", "their")
PORTUGUESE_MARKERS = (" que ", " de ", " para ", " não", " uma ", " um ", " com ", " ao ", " na ", " no ")
ASSISTANT_MARKERS = ("as an ai", "here is the refined text", "<think>", "</think>", "assistant:", "user:", "como um modelo de linguagem")
STRUCTURE_MARKERS = ("<think>", "assistant:", "user:", "===glossario_s", "```")
IGNORED_WORDS = "a o as os de da do das dos e é em na no nas nos um uma que se por para com ao aos à às eu ela ele eles elas não mais".split()
SOURCE_LEAKS = ("S-class", "Dragonslayer", "Arright", "boost", "they", "Phew", "Geez", "Huh", "Ugh", "buff", "buffs", "ain't", "ain’t", "selves", "I see", "KYS")
PENALTIES = (
    ("bad_alias_in_target", 10),
    ("source_term_in_target", 8),
    ("missing_canonical_term", 6),
    ("residual_english", 5),
    ("residual_source_language", 5),
    ("english_meta_text", 8),
    ("possible_gender_mismatch", 3),
    ("residual_translation_marker", 10),
    ("unbalanced_quotes", 4),
    ("malformed_quote_boundary", 6),
    ("missing_quote_spacing", 3),
    ("stray_format_marker", 3),
)
OTHER_PENALTY = 2
ENTITY = "\\b[A-ZÁÉÍÓÚÂÊÔÃÕÄÖÜ][\\wÁÉÍÓÚÂÊÔÃÕÄÖÜ-]{2,}\\b"
NAME = "\\b[A-ZÀ-Ý][a-zà-ÿ]{2,}\\b"

# cross-volume checks
FEMININE = ("ela", "dela", "sua", "a guerreira")
MASCULINE = ("ele", "dele", "seu", "o guerreiro")
FEMININE_NOTES = ("heroína", "ela", "sacerdotisa", "princesa")
MASCULINE_NOTES = ("herói", "ele", "guerreiro", "príncipe")
INFORMAL = ("cara", "mano", "hein", "uh", "ah", "né")
FORMAL = ("vós", "senhor", "senhora", "venerável", "humilde")
TIMELINE = (("perdeu_braco", "perdeu o braço direito"), ("usou_braco", "ergueu o braço direito"), ("morreu", r"\bmorreu\b"), ("vivo", r"\bapareceu vivo\b"))
ALIAS_WORDS = "anciaos ancioes arma barao cacador cacadores calice cavaleiros cidade cla de dente dragao exterminador exterminadores filhos fortaleza grande matador matadores monstros olho quatro rei ruinas sabio sagrados santos senhor senhora tigre tigres".split()
ACCENTS = ("áàâãäéèêëíìîïóòôõöúùûüçÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇ", "aaaaaeeeeiiiiooooouuuucAAAAAEEEEIIIIOOOOOUUUUC")


# rewriting rules, as (pattern, replacement) in Java's dialect; fixed values that results depend on
DIALOGUE_BREAKS = (("”{2,}\\s*“", "”\n\n“"), ('"{2,}\\s*"', '"\n\n"'), ("”\\s*“", "”\n\n“"), ('"\\s*"', '"\n\n"'))
SAFE_DIALOGUE_BREAKS = (("”{2,}\\s*“", "”\n\n“"), ("”\\s*“", "”\n\n“"))
QUOTE_SPACING = (
    ('([“"])[ \\t]+', "$1"),
    ('[ \\t]+([”"])', "$1"),
    ('([”"])(?=[“"])', "$1 "),
    ("(?<=[\\p{L}\\p{N}_.,;:!?…])(?=“[A-Za-zÀ-ÿ])", " "),
    ('(?<=[”"])(?=[A-Za-zÀ-ÿ])', " "),
)
PUNCTUATION = (
    ("“['‘]", "“"),
    ("['’]”", "”"),
    ("(?m)^(\\s*)”\\s*(?=“[A-Za-zÀ-ÿ])", "$1"),
    ('([”"])\\1+', "$1"),
    ('([.!?…][”"])\\*(?=\\s|$)', "$1"),
    ("([?!…])”\\.", "$1”"),
    ("—,\\s*", "—"),
    ("(?<=\\S)—(?=\\S)", " — "),
    ("—(?=[A-Za-zÀ-ÿ])", "— "),
    ("\\s+([.!?])", "$1"),
    ("[ \\t]{2,}", " "),
)
INLINE_MARKS = (("(?i)https?://\\S+", ""), ("(?i)\\bwww\\.\\S+", ""), ("(?i)\\b(?:[a-z0-9-]+\\.)+[a-z]{2,63}(?:[/?#]\\S*)?", ""), ("[ ]{2,}", " "), ("\\n[ ]+", "\n"))
HYPHEN_BREAK = "([A-Za-z]{1,24})-\\s*\\n\\s*([A-Za-z]{1,24})"
ELLIPSIS_SPACING = (("…(?![A-Z]{2})([A-Za-z])", "… $1"), ("\\.\\.\\.(?![A-Z]{2})([A-Za-z])", "... $1"), ("…\\s{2,}(?=[A-Za-z])", "… "), ("\\.\\.\\.\\s{2,}(?=[A-Za-z])", "... "))
THINKING = "(?is)<think>.*?</think>"
MODEL_PHRASES = ("Here is the refined text:", "Texto refinado:", "Here is the text:")
MARKERS = "(?i)###\\s*(?:TEXTO_TRADUZ[A-Z_]*|TEXTO_REFINADO_[A-Z_]*)"
EDITOR_LITE = (("(?iU)\\b(\\w+)\\s+\\1\\b", "$1"), ("\\s+([,.;!?])", "$1"), ("[ \\t]{2,}", " "))
EDITOR_STRICT = (("(?i)\\btipo,\\s*", ""), ("(?i)\\bcomo se (ele|ela) fosse tipo\\b", "como se $1 fosse"), ("(?i)\\b(muito\\s+){2,}", "muito "), ("[ \\t]{2,}", " "), ("\\s+([,.;!?])", "$1"))
EDITOR_VOICE = (("\\.{4,}", "…"), ("[ \\t]{2,}", " "))
# a glued speech: the pattern's first group ends a line
GLUED = ("([.!?…][\"”])\\s+(?=[\"“])", "([.!?…])\\s+(?=—\\s*)")
# English left in Portuguese, and its Portuguese
LEFT_ENGLISH = (
    ("(?i)(?<![A-Za-zÀ-ÿ])I-isso\\b", "S-sim"),
    ("(?i)(?<![A-Za-zÀ-ÿ])I\\s+(?=[a-zà-ÿ])", "Eu "),
    ("(?i)\\buh+\\b", "Ah"),
    ("(?i)\\barright\\b", "Beleza"),
    ("(?i)\\bboost\\b", "impulso"),
    ("(?i)\\bthey\\s+todos\\b", "todos"),
    ("(?i)\\bY-you\\s+divindades\\s+podem\\b", "V-vocês, divindades, podem"),
    ("(?i)\\bY-you\\b", "V-você"),
    ("(?i)\\b(super\\s+)?desconfiad([ao])\\s+AF\\b", "$1desconfiad$2 pra caramba"),
    ("(?i)\\bthough\\b", "porém"),
)
BIRTH = "(?iu)\\b(bebe|bebes|bebê|bebês|filh[oa]s?|gravidez|gr[aá]vida|gesta[cç][aã]o|matern|parto)\\b"
PARRY_SOURCE = "(?i)\\bparr(?:y|ied|ying)\\b"
PARRY = (
    ("(?i)\\bparr(?:ir|r)\\b", "aparar"),
    ("(?i)\\bparrid([oa]s?)\\b", "aparad$1"),
    ("(?i)\\bparriam\\b", "aparavam"),
    ("(?i)\\bparria\\b", "aparava"),
    ("(?i)\\bparr(?:iu|indo|ou)\\b", "aparou"),
)
DASH_AND_QUOTE = (('^(—\\s.*?)["”](?=[,;.\\s]|$)', "$1"), ('^(—\\s*)["“]\\s*(.+)$', "$1$2"), ('^(—\\s[^"”]{0,120}?)["”]([\\s,;.!?]+[A-Z\\x{00c0}-\\x{017f}].*)$', "$1$2"))
LEXICAL = (("(?i)\\bpoderam\\b", "puderam"), ("(?i)\\bphew\\b", "Ufa"), ("(?i)\\bgeez\\b", "Nossa"), ("(?i)\\bhuh\\b", "Hã"), ("(?i)\\bugh\\b", "Argh"))
# editorial replacements: pattern, replacement, whether the case of what is replaced is kept
EDITORIAL = (
    (r"\bEu wish\b", "Quem me dera", False),
    (r"(?<=\w)—or\b", " — ou", False),
    (r"(?<=\w)—,", " —,", False),
    (r"\bbipede\b", "bípede", True),
    (r"\bsemi-deuses\b", "semideuses", True),
    (r"\bTh-the… y’re…", "El-eles…", False),
    (r"\bsus\s+AF\b", "suspeita pra caramba", False),
    (r"\bmeow\b", "miau", True),
    (r"\bskills\b", "habilidades", True),
    (r"\bskill\b", "habilidade", True),
)

# headings and structure
HEADINGS = (
    ("(?iu)^(?:prologue|pr[oó]logo|prolog|序章|前言|プロローグ|프롤로그)$", "# Prólogo"),
    ("(?iu)^(?:epilogue|ep[ií]logo|epilog|終章|终章|エピローグ|에필로그)$", "# Epílogo"),
    ("(?iu)^(?:afterword|posf[aá]cio|p[oó]s[- ]?escrito|あとがき|後書き|后记|後記|후기)$", "# Pós-escrito"),
)
CHAPTERS = (
    "(?iu)^(?:chapter|cap[ií]tulo|chapitre|kapitel|capitolo|glava|глава)\\s+(\\d+|[一二三四五六七八九十百零〇]+)(?:\\s*[:：–—-]\\s*(.*))?$",
    "^第\\s*(\\d+|[一二三四五六七八九十百零〇]+)\\s*[章話话巻卷](?:\\s*[:：–—-]?\\s*(.*))?$",
    "^제\\s*(\\d+|[일이삼사오육칠팔구십백]+)\\s*장(?:\\s*[:：–—-]?\\s*(.*))?$",
)
PT_HEADING = "(?iu)^#?\\s*(pr[oó]logo|cap[ií]tulo\\s+[0-9一二三四五六七八九十百零〇]+(?::[^\\n]*)?|ep[ií]logo|p[oó]s[- ]?escrito|posf[aá]cio)\\s*$"
SCENE = "^\\s*(?:\\*\\s*){3,}\\s*$|^\\s*[—–-]{3,}\\s*$"
SUBTITLE = "^[A-Za-zÀ-ÖØ-öø-ÿ0-9'’,:;\\- ][A-Za-zÀ-ÖØ-öø-ÿ0-9'’,:;—\\- ]*$"
TIME_LABEL = "^([A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’-]+(?:\\s+[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’-]+){1,3})\\s+(?:ALGUM TEMPO ANTES(?:,\\s*há um tempo)?…?)$"
TIME_LABEL_TEXT = "Algum tempo antes…"
SMALL_CAPS_PT = "^(DEPOIS QUE|APÓS|QUANDO|ENQUANTO)\\s+([A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'’-]{2,})(\\s+.*[a-zà-öø-ÿ].*)$"
SPACED_CAPITALS = "\\b(?:[A-Z]\\s+){2,}[A-Z][A-Za-z]*\\b"
ATTRIBUTION_VERBS = (
    "disse perguntou respondeu provocou gritou exigiu explicou implorou exclamou sussurrou murmurou retrucou continuou observou comentou admitiu "
    "declarou disparou chamou repetiu insistiu rosnou resmungou falou pediu ordenou avisou começou interrompeu pareceu"
).split()
NAME_TOKEN = "[A-ZÁÉÍÓÚÂÊÔÃÕÇ][\\wÀ-ÿ@.'-]*"
ATTRIBUTION = "(?iu)^(?:" + NAME_TOKEN + "(?:\\s+" + NAME_TOKEN + "){0,3}\\s+)?(?:" + "|".join(ATTRIBUTION_VERBS) + ")\\b.*"
PRONOUN_START = "(?iu)^(?:eu|você|voce|vocês|voces|tu|ele|ela|eles|elas|nós|nos|a gente)\\b"
NAME_CONNECTORS = ("da", "das", "de", "do", "dos", "e")
ENTITY_CATEGORIES = ("person", "personagem", "criatura", "local", "organiza", "organização", "raça", "apelido")
PART_CATEGORIES = ("person", "personagem", "criatura", "apelido")
PERSON_CATEGORIES = ("person", "personagem")
GENDERED_CATEGORIES = ("person", "personagem", "criatura")
# articles before a feminine name and what they should be; before a masculine name the other way round
ARTICLES = (("o", "a"), ("O", "A"), ("do", "da"), ("Do", "Da"), ("no", "na"), ("No", "Na"), ("ao", "à"), ("Ao", "À"))

# audits
AUDIT_NOISE = ("newsletter", "table of contents", "download all your favorite light novels", "favorite light novels", "sign up for", "thank you for reading", "thank you for downloading", "visit us online", "join our community")
AUDIT_URL = "(?:https?://|www\\.)|(?:\\w+\\.(?:example|test|invalid)(?:[/?#]|$))"
AUDIT_CONTENTS = "^(?:chapter\\s+\\d+|prologue|epilogue|afterword|color inserts|title page)$"
#: One of these stands wherever the pattern above it can hold; looking for them is much cheaper.
AUDIT_URL_PARTS = ("http", "www.", ".example", ".test", ".invalid")
AUDIT_CONTENTS_PARTS = ("chapter", "prologue", "epilogue", "afterword", "color inserts", "title page")
STORY_START = "(?i)^(?:prologue|chapter\\s+(?:\\d+|one)\\b|epilogue)"

# answers of a model that tell of themselves, strictly
META_STRICT = (
    r"parece que voc[eˆ] est[ a]",
    r"como um modelo de linguagem",
    r"n[aÆ]o posso",
    r"n[aÆ]o sou capaz",
    r"nÆo posso ajudar",
    r"eu sou apenas",
    r"como um assistente",
    r"as an ai language model",
    r"i am an ai",
    r"i cannot provide",
    r"i'm just an ai",
    r"as a language model",
    r"^\s*mudanc(a|‡)as e justificativas[:]?.*$",
    r"^\s*alterac(ao|Æo|oes|äes) realizadas[:]?.*$",
    r"^\s*(nesta|nessa) revis(ao|Æo).*$",
    r"^\s*(justificativa|racionalidade|rationale).*$",
    r"^\s*em resumo.*$",
    r"^\s*resumo[: ].*$",
)
META_REFINE = ("as an ai", "as a language model", "sou um modelo de linguagem", "como um modelo de linguagem", "<think>", "</think>")
REFINED_BLOCK = r"(?is)###\s*TEXTO_REFINADO_INICIO\s*(.*?)\s*###\s*TEXTO_REFINADO_FIM"
REPAIRED_BLOCK = r"(?is)###\s*TEXTO_REPARADO_INICIO\s*(.*?)(?:###\s*TEXTO_REPARADO_FIM\s*|$)"
REFINED_FRAME = r"(?m)^\s*(?:\*{3,}|-{3,})\s*$"
REFINED_PREAMBLE = (
    r"(?is)(?:aqui\s+est[áa]|segue\s+(?:a\s+)?revis[ãa]o|revis[ãa]o\s+(?:do|deste)|here\s+is|below\s+is).{0,180}(?:texto|revis[ãa]o|ajuste)"
    r"|(?:principais\s+)?(?:ajustes|altera[çc][õo]es|mudan[çc]as)\s+(?:feitos|realizadas|e\s+notas)"
)
REFINED_HEADING = r"(?im)^\s*(?:#{1,6}\s*)?(?:\*{1,2}\s*)?(?:texto\s+(?:revisado|refinado)|revis[ãa]o\s+do\s+texto)(?:\s*\([^\n)]*\))?\s*:?[\s*]*$"
REFINED_NOTES = r"(?im)^\s*(?:#{1,6}\s*)?(?:\*{1,2}\s*)?(?:(?:principais\s+)?(?:ajustes|altera[çc][õo]es|mudan[çc]as|notas|observa[çc][õo]es)(?:\s+(?:feitos|realizadas|da\s+revis[ãa]o))?)\s*:?[\s*]*$"
SUGGESTED = ("===GLOSSARIO_SUGERIDO_INICIO===", "===GLOSSARIO_SUGERIDO_FIM===")

# quality checks
ENGLISH_META = r"(?i)\b(The narrative|Key characters|story highlights|training grounds|Chapter\s+\d+)\b"
MASCULINE_WORDS = "atento envergonhado culpado calado quieto sozinho preparado confuso surpreso irritado exausto sentado parado ferido machucado louco alto".split()
FEMININE_WORDS = "atenta envergonhada culpada calada quieta sozinha preparada confusa surpresa irritada exausta sentada parada ferida machucada louca".split()
MIXED_GENDERS = (
    (r"\bcuidadosa\b.{0,50}\batento\b", "cuidadosa/atento"),
    (r"\batenta\b.{0,50}\bcuidadoso\b", "atenta/cuidadoso"),
    (r"\benvergonhada\b.{0,50}\bculpado\b", "envergonhada/culpado"),
    (r"\benvergonhado\b.{0,50}\bculpada\b", "envergonhado/culpada"),
    (r"\bpreparada\b.{0,50}\bpronto\b", "preparada/pronto"),
    (r"\bpreparado\b.{0,50}\bpronta\b", "preparado/pronta"),
)
BEING = r"(?:é|era|está|estava|foi|ficou|parecia|permaneceu|continuou|voltou|sentou(?:-se)?)"
DEGREE = r"(?:\s+(?:mais|muito|bem|tão|menos|um|pouco)){0,3}"
MOST_ISSUES = 80
# a narration's beginning behind a speech
NARRATION = (
    r"(?<=[.!?])\s+(?:(?:Ele|Ela|Eles|Elas)\s+[A-Za-zÀ-ÖØ-öø-ÿ'’-]+|"
    r"(?:[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’-]+(?:\s+[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’-]+)?)\s+(?:disse|perguntou|respondeu|sussurrou|gritou|murmurou))\b"
)
# internal hyphens that stay
HYPHEN_PREFIXES = ("demi", "half", "anti", "non", "pre", "post", "re")
HYPHEN_SUFFIXES = ("san", "sama", "kun", "chan")
LANGUAGE_RULES = (
    ("en", "Avoid the source's syntax; turn possessives into natural Portuguese."),
    ("ja", "Keep honorifics that tell how persons relate; do not invent subject, number or gender that is left out."),
    ("ko", "Keep levels of politeness in natural speech; do not name a subject or gender that is left open."),
    ("zh", "Treat titles and forms of address as the glossary does; resolve missing subjects from the context alone."),
)
OTHER_LANGUAGE_RULE = "Keep what the source leaves open, and avoid its syntax."
# fixed values of the rules over lines
WORD_TAIL = "([-–—.,;:!?…'\"”’]+)$"
PT_CHAPTER = r"(?:#\s*)?cap[ií]tulo\s+(\d+):?\s*"
PT_TITLED = r"#\s*cap[ií]tulo\s+(\d+):\s+(\S.+?)\s*"
PT_BARE = r"#\s*cap[ií]tulo\s+(\d+):?\s*"
PT_HEAD = r"(pr[oó]logo|cap[ií]tulo\s+[^\s].*?|ep[ií]logo|interl[úu]dio)(.*)"
WHOLE_SPEECH = r"(?:[\"“].+[\"”]\s*|—\s?.+)"
WHO_SAID = r"(perguntou|disse|respondeu)\s+\w+\.?"
GULP = r"gulp[.!?…]?"
# lines that are searched for contents, marks that make contents, characters of a short body, and the share of short ones
CONTENTS_LINES, CONTENTS_MARKS, CONTENTS_BODY, CONTENTS_SHARE = 200, 4, 50, 0.6
# word characters between two closing quotes that make the first too early
PROSE_BETWEEN_QUOTES = 8
# lengths of entries of contents, of inline marks and of lines with few letters, and how few letters those have
ENTRY_CHARS, MARK_CHARS, THIN_CHARS, THIN_LETTERS = 120, 180, 140, 0.65
# what the editors' memory may prefer: (name, pattern, replacement)
EDITOR_PREFERENCES = (("past_preference", r"(?U)\b[eE]ra como se (ele|ela) é\b", "era como se $1 fosse"),)
