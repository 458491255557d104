"""Word lists and patterns of spoken English and captions, shared by column functions and task code."""

from __future__ import annotations

# Words after which a sentence is not finished, in the order of the specification.
DANGLING_WORDS = (
    "a|an|the|to|of|in|on|at|for|with|and|or|but|if|as|"
    "is|are|was|were|be|been|being|will|would|could|should|can|may|might|must|"
    "not|no|so|just|very|more|most|less|than|then|"
    "that|this|these|those|there|here|"
    "i|we|you|they|he|she|it|my|our|your|their|his|her|its|"
    "me|us|him|them|who|whom|whose|which|what|when|where|why|how|"
    "going|trying|looking|want|wants|need|needs|like|likes|from|into|"
    "about|over|under|between|by|do|does|did|have|has|had|"
    "don't|doesn't|didn't|won't|can't|couldn't|shouldn't|isn't|aren't|"
    "i'm|we're|you're|they're|he's|she's|it's|that's|there's|who's|what's|"
    "let's|gonna|wanna|gotta|kinda|sorta|able|still|also|even|only|"
    "really|actually|basically|probably|maybe|something|anything|"
    "everything|nothing|someone|anyone|everyone|because|while|after|"
    "before|until|unless|whether|though|although|through"
)

# Openings of clauses before which a long text may be cut.
CLAUSE_WORDS = (
    "but|so|and then|then|now|okay|alright|all right|well|look|"
    "because|however|instead|except|also|plus|still|right|"
    "i mean|you know|the thing is|what i|what you|what we"
)

# Fillers that carry no meaning, hesitations alone and with spoken phrases.
HESITATIONS = "um+|uh+"
FILLERS = "um+|uh+|you know|i mean|okay|ok"

# Sentence marks, and what may close a quotation or bracket after them.
SENTENCE_MARKS = ".!?…"
CLOSERS = "\"'”’)\\]"

# After these a caption line may break.
BREAK_AFTER = "，。！？；：、,.!?;: "

# What a reply line loses, and how a Chinese line is shortened step by step.
REPLY_FILLERS = ["你知道的，", "好吧，", "嗯，", "呃，"]
SHORTENINGS = [
    ("我们", ""), ("一个", ""), ("这个", ""), ("那个", ""), ("然后", ""), ("显然", ""),
    ("其实", ""), ("你看", ""), ("我会", "我"), ("进行", ""), ("的话", ""), ("一下", ""),
]
