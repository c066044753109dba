"""Plain Python answers for small cases."""


def split(text, stopwords=()):
    return [word for word in text.split() if word not in stopwords]


def frequency(words, total):
    return round(words / total * 1e5) / 1e5


def exact_count(words, wanted):
    n = len(wanted)
    return sum(words[i : i + n] == wanted for i in range(len(words) - n + 1))


def run_count(words, wanted):
    if len(wanted) == 1:
        return words.count(wanted[0])
    runs, current = [], []
    for word in words:
        if word in wanted:
            current.append(word)
        elif current:
            runs.append(current)
            current = []
    if current:
        runs.append(current)
    n = len(wanted)
    return sum(len(run) >= n and (run[:n] == wanted or run[-n:] == wanted) for run in runs)


def answers(texts, requests, mode, stopwords=()):
    """{query_id: {text_id: (hits, matching_words, total_words, frequency)}} with texts as {id: text}."""
    count = run_count if mode == "run" else exact_count
    found = {}
    for query_id, request in requests.items():
        wanted = split(request, stopwords)
        if not wanted:
            continue
        for text_id, text in texts.items():
            words = split(text, stopwords)
            hits = count(words, wanted) if set(wanted) <= set(words) else 0
            if hits:
                matching = hits * len(wanted)
                score = (hits, matching, len(words), frequency(matching, len(words)))
                found.setdefault(query_id, {})[text_id] = score
    return found


def ranked(found, n):
    """{query_id: [text_id, ...]} by frequency, then id."""
    return {
        query_id: [text_id for text_id, _ in sorted(hits.items(), key=lambda item: (-item[1][3], item[0]))][:n]
        for query_id, hits in found.items()
    }
