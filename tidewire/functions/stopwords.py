"""Default English stop lists: one for cleaning, one for the vocabulary."""

# The common English stop list of 179 words.
ENGLISH = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn "
    "couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn "
    "mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't "
    "won won't wouldn wouldn't"
).split()

# Words that the usual list of vectorisers (318 words) has besides those it shares with ``ENGLISH``.
FURTHER = (
    "across afterwards almost alone along already also although always among amongst amoungst amount another anyhow "
    "anyone anything anyway anywhere around back became become becomes becoming beforehand behind beside besides "
    "beyond bill bottom call cannot cant co con could couldnt cry de describe detail done due eg eight either eleven "
    "else elsewhere empty enough etc even ever every everyone everything everywhere except fifteen fifty fill find "
    "fire first five former formerly forty found four front full get give go hasnt hence hereafter hereby herein "
    "hereupon however hundred ie inc indeed interest keep last latter latterly least less ltd made many may meanwhile "
    "might mill mine moreover mostly move much must name namely neither never nevertheless next nine nobody none noone "
    "nothing nowhere often one onto others otherwise part per perhaps please put rather see seem seemed seeming seems "
    "serious several show side since sincere six sixty somehow someone something sometime sometimes somewhere still "
    "system take ten thence thereafter thereby therefore therein thereupon thick thin third though three throughout "
    "thru thus together top toward towards twelve twenty two un upon us via well whatever whence whenever whereafter "
    "whereas whereby wherein whereupon wherever whether whither whoever whole whose within without would yet"
).split()

# Words of ``ENGLISH`` without an apostrophe that the list of vectorisers lacks.
_CLEANING_ONLY = (
    "theirs having does did doing s t just don d ll m o ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn "
    "mustn needn shan shouldn wasn weren won wouldn"
).split()

VECTORISER = sorted(set(FURTHER) | {w for w in ENGLISH if "'" not in w and w not in _CLEANING_ONLY})
