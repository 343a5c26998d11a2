"""The English word lists of the transcript stages."""

FILLERS = [
    "um", "uh", "umm", "uhh", "er", "ah", "eh", "mm", "hmm",
    "you know", "i mean", "you see", "sort of", "kind of",
    "basically", "actually", "literally", "like i said",
    "to be honest", "honestly", "i guess", "i suppose",
    "or something", "or whatever", "and stuff", "and things",
    "know what i mean", "if you will",
]

PROPER_NOUNS = [
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
    "america", "american", "english", "british", "chinese", "google", "microsoft",
    "apple", "amazon", "facebook", "twitter", "youtube", "instagram",
]

ABBREVIATIONS = [
    "usa", "uk", "eu", "ai", "ml", "api", "url", "html", "css", "js",
    "pdf", "jpg", "png", "mp3", "mp4", "cpu", "gpu", "ram", "ssd",
    "ceo", "cto", "cfo", "hr", "pr", "faq", "diy", "eta", "fyi", "asap",
]

QUESTION_STARTERS = [
    "what", "why", "how", "when", "where", "who", "which",
    "can", "could", "would", "should", "will", "do", "does",
    "did", "is", "are", "was", "were", "have", "has",
]

MOOD_WORDS = ["amazing", "awesome", "fantastic", "terrible"]

CONTRAST_WORDS = [
    "but", "however", "therefore", "moreover", "furthermore",
    "meanwhile", "nevertheless", "consequently", "thus",
]

PRONOUNS = ["he", "she", "we", "they"]

CONJUNCTIONS = ["and", "but", "or", "yet", "so"]

OPENERS = [
    "However", "Therefore", "Moreover", "Furthermore", "Meanwhile", "Nevertheless", "Consequently", "Thus",
]

TRANSITIONS = [
    "However", "Therefore", "Moreover", "Furthermore", "Meanwhile", "In addition", "On the other hand",
    "In conclusion", "To summarize", "First", "Second", "Finally", "Next", "Then",
]

CONTRACTIONS = {
    "gonna": "going to",
    "wanna": "want to",
    "gotta": "got to",
    "kinda": "kind of",
    "cause": "because",
}
