"""Schemas (DDL) of the nested source records; every reader gets one, nothing is inferred."""

USER = "STRUCT<id: LONG, profileId: LONG, displayName: STRING, username: STRING, avatarUrl: STRING, score: LONG>"
PERSON = "STRUCT<profileId: LONG, name: STRING, username: STRING, avatar: STRING>"
_side = "STRUCT<amountWeiTotal: DECIMAL(38,0), count: LONG>"
PROFILE = (
    "id LONG, profileId LONG, displayName STRING, username STRING, avatarUrl STRING, description STRING, score LONG, status STRING, userkeys ARRAY<STRING>, "
    "xpTotal LONG, xpStreakDays INT, xpRemovedDueToAbuse BOOLEAN, influenceFactor DOUBLE, influenceFactorPercentile DOUBLE, links STRUCT<profile: STRING, scoreBreakdown: STRING>, "
    f"stats STRUCT<review: STRUCT<received: STRUCT<negative: LONG, neutral: LONG, positive: LONG>>, vouch: STRUCT<given: {_side}, received: {_side}>>"
)
VOUCHES = f"values ARRAY<STRUCT<authorProfileId: LONG, subjectProfileId: LONG, authorUser: {USER}, subjectUser: {USER}, balance: STRING, vouchedAt: STRING>>, total LONG, limit LONG, offset LONG"
REVIEWS = (
    "values ARRAY<STRUCT<type: STRING, data: STRUCT<id: LONG, authorProfileId: LONG, author: STRING, subject: STRING, score: STRING, comment: STRING, createdAt: LONG, archived: BOOLEAN>, "
    f"authorUser: {USER}, subjectUser: {USER}, author: {PERSON}, subject: {PERSON}>>, total LONG"
)
INVITATIONS = f"values ARRAY<STRUCT<id: LONG, senderProfileId: LONG, acceptedProfileId: LONG, level: INT, user: {USER}>>"
XP_WEEKS = "week INT, startDate STRING, endDate STRING"
XP_WEEKLY = "week INT, weeklyXp LONG, cumulativeXp LONG"
SEASONS = "seasons ARRAY<STRUCT<id: INT, name: STRING>>, currentSeason STRUCT<id: INT>"
CACHE_ENTRY = "key STRING, data STRING, timestamp LONG, version STRING"
RECENT = "query STRING, displayName STRING, username STRING, avatarUrl STRING, timestamp LONG"
