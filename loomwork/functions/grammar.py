"""Fixed values of the problem grammar: task names, first lines, patterns and the word list."""

from __future__ import annotations

# Fixed values.
TASKS = ("bit_manipulation", "gravity", "unit_conversion", "numeral", "cipher", "symbolic_transform")
PREFIXES = {
    "bit_manipulation": "In Alice's Wonderland, a secret bit manipulation rule transforms 8-bit binary numbers. The transformation involves operations like bit shifts, rotations, XOR, AND, OR, NOT, and possibly majority or choice functions.",
    "gravity": "In Alice's Wonderland, the gravitational constant has been secretly changed. Here are some example observations:",
    "unit_conversion": "In Alice's Wonderland, a secret unit conversion is applied to measurements. For example:",
    "numeral": "In Alice's Wonderland, numbers are secretly converted into a different numeral system. Some examples are given below:",
    "cipher": "In Alice's Wonderland, secret encryption rules are used on text. Here are some examples:",
    "symbolic_transform": "In Alice's Wonderland, a secret set of transformation rules is applied to equations. Below are a few examples:",
}
BIT_HEADER = "Here are some examples of input -> output:"
NUMBER = r"-?\d+(?:\.\d+)?"
ROMAN = r"M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"
WORDS = r"[a-z]+(?: [a-z]+)*"
SYMBOLS = r"[0-9!-/:-@\[-`{-~]+"
EXAMPLE = {
    "bit_manipulation": r"[01]{8} -> [01]{8}",
    "gravity": rf"For t = {NUMBER}s, distance = {NUMBER} m",
    "unit_conversion": rf"{NUMBER} m becomes {NUMBER}",
    "numeral": r"\d+ -> [IVXLCDM]+",
    "cipher": rf"{WORDS} -> {WORDS}",
    "symbolic_transform": rf"{SYMBOLS} = {SYMBOLS}",
}
QUERY = {
    "bit_manipulation": r"Now, determine the output for: [01]{8}",
    "gravity": rf"Now, determine the falling distance for t = {NUMBER}s given d = 0\.5\*g\*t\^2\.",
    "unit_conversion": rf"Now, convert the following measurement: {NUMBER} m",
    "numeral": r"Now, write the number \d+ in the Wonderland numeral system\.",
    "cipher": rf"Now, decrypt the following text: {WORDS}",
    "symbolic_transform": r"Now, determine the result for: (.+)",
}
ANSWER = {
    "bit_manipulation": r"[01]{8}",
    "gravity": r"-?\d+\.\d{1,2}",
    "unit_conversion": r"-?\d+\.\d{2}",
    "numeral": rf"(?=.){ROMAN}",
    "cipher": WORDS,
    "symbolic_transform": r"(?=.{1,4}\z)" + SYMBOLS,
}
EXAMPLES = {"bit_manipulation": (7, 10), "gravity": (3, 5), "unit_conversion": (3, 5), "numeral": (3, 5), "cipher": (3, 5), "symbolic_transform": (3, 5)}
QUESTION = {
    "bit_manipulation": r"Now, determine the output for: ([01]{8})",
    "gravity": rf"falling distance for t = ({NUMBER})s",
    "unit_conversion": rf"convert the following measurement:\s+({NUMBER})\s+\S+",
    "numeral": r"write the number (\d+) in the Wonderland numeral system",
    "cipher": r"decrypt the following text: ([^\n]+)\n?\z",
    "symbolic_transform": r"determine the result for: ([^\n]+)\n?\z",
}
PAIRS = {
    "bit_manipulation": r"([01]{8}) -> ([01]{8})",
    "gravity": rf"For t = ({NUMBER})s, distance = ({NUMBER}) m",
    "unit_conversion": rf"({NUMBER})\s+\S+\s+becomes\s+({NUMBER})",
}
WORD_LIST = (
    "above", "alice", "ancient", "around", "beyond", "bird", "book", "bright", "castle", "cat", "cave", "chases", "clever", "colorful", "creates", "crystal", "curious", "dark", "discovers", "door", "dragon", "draws", "dreams",
    "explores", "follows", "forest", "found", "garden", "golden", "hatter", "hidden", "imagines", "in", "inside", "island", "key", "king", "knight", "library", "magical", "map", "message", "mirror", "mountain", "mouse",
    "mysterious", "near", "ocean", "palace", "potion", "princess", "puzzle", "queen", "rabbit", "reads", "school", "secret", "sees", "silver", "story", "strange", "student", "studies", "teacher", "the", "through", "tower",
    "treasure", "turtle", "under", "valley", "village", "watches", "wise", "wizard", "wonderland", "writes",
)
