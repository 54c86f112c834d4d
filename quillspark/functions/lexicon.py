"""Word lists and patterns with fixed values, and parameters that callers may replace."""

# They decide which titles and summaries are accepted.
OBITUARY = ("obituary", "passed away", "death notice", "funeral services for", "memorial service for")
REAL_ESTATE = ("realtor", "zillow", "redfin", "listing", "for sale", "house for", "home for", "property", "$")
REFUSAL = (
    "please provide the article",
    "i don't have access",
    "i do not have access",
    "i can't",
    "i cannot",
    "cannot summarize",
    "no article content",
    "unable to summarize",
    "article not provided",
    "no content available",
    "write a detailed summary for you",
    "i am not able to",
    "i'm not able to",
    "please provide the source",
)
BOILERPLATE = (
    "this highlights a significant",
    "this suggests a",
    "this indicates a",
    "further details on the nature",
    "further details are not",
    "are not included",
    "are not specified",
    "details regarding",
    "this serves as",
    "this demonstrates",
    "this underscores",
    "this reflects",
    "this signals",
    "this article discusses",
    "this story covers",
    "the author writes",
    "according to",
    "the report states",
    "in this piece",
    "this piece explores",
    "this article explores",
    "the article examines",
    "this story examines",
    "the following article",
    "the following story",
)
TOPIC_STOP = tuple(
    "the a an and or but of to in on for with at by from is are was were be been this that these those as it its into "
    "after over amid than their his her has have had will would could should about which who what says said new more "
    "not also some such each".split()
)
HEADLINE_STOP = tuple("news says live update updates here what how why when year report story today".split())
TAG_STOP = ("new", "newly", "news", "novel", "world", "global", "globals", "first", "report", "analysis")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
AUTO_MARK = "[Auto]"
UNAVAILABLE_MARK = "[Summary Unavailable]"
