"""Kinds of matrices by what their labels say."""

from __future__ import annotations

#: The kinds and their labels.
LABELS = {
    "OBSERVED": "Observed",
    "EXPECTED": "Expected",
    "OE": "Observed/Expected",
    "PROB": "Observed Probability",
    "PROB2": "Observed Probability Inf",
    "OEV2": "Log(Observed/Expected)",
    "OEP1": "(Observed+1)/(Expected+1)",
    "OEP1V2": "Log((Observed+1)/(Expected+1))",
    "OME": "Observed-Expected",
    "PEARSON": "Observed Pearson",
    "LOG": "Log(Observed+1)",
    "LOGEO": "Log(Observed+1)/Log(Expected+1)",
    "METALOGEO": "(Log(Observed+1)+1)/(Log(Expected+1)+1)",
    "EXPLOGEO": "e^(Log(Observed+1)/Log(Expected+1))",
    "EXPLOGEOINV": "e^(Log(Expected+1)/Log(Observed+1))",
    "NORM2": "Observed Norm^2",
    "CONTROL": "Control",
    "OECTRL": "Control/ExpectedC",
    "PROBCTRL": "Control Probability",
    "PROB2CTRL": "Control Probability Inf",
    "OECTRLV2": "Log(Control/ExpectedC)",
    "OECTRLP1": "(Control+1)/(ExpectedC+1)",
    "OECTRLP1V2": "Log((Control+1)/(ExpectedC+1))",
    "CME": "Control-ExpectedC",
    "PEARSONCTRL": "Control Pearson",
    "LOGC": "Log(Control+1)",
    "LOGCEO": "Log[Control+1]/Log[ExpectedC+1]",
    "EXPLOGCEO": "e^(Log[Control+1]/Log[ExpectedC+1])",
    "NORM2CTRL": "Control Norm^2",
    "RATIO": "Observed/Control * (AvgC/AvgO)",
    "RATIOV2": "Log(Observed/Control * (AvgC/AvgO))",
    "RATIOP1": "(Observed+1)/(Control+1) * (AvgC+1)/(AvgO+1)",
    "RATIOP1V2": "Log((Observed+1)/(Control+1) * (AvgC+1)/(AvgO+1))",
    "RATIO0": "Observed/Control * (ExpC0/Exp0)",
    "RATIO0V2": "Log(Observed/Control * (ExpC0/Exp0))",
    "RATIO0P1": "(Observed+1)/(Control+1) * (ExpC0+1)/(Exp0+1)",
    "RATIO0P1V2": "Log((Observed+1)/(Control+1) * (ExpC0+1)/(Exp0+1))",
    "VS": "Observed vs Control",
    "OEVS": "Observed/Expected vs Control/ExpectedC",
    "PROBVS": "Probability Observed vs Control",
    "PROB2VS": "Probability Inf Observed vs Control",
    "OEVSV2": "Log(Observed/Expected) vs Log(Control/ExpectedC)",
    "OEVSP1": "(Observed+1)/(Expected+1) vs (Control+1)/(ExpectedC+1)",
    "OEVSP1V2": "Log((Observed+1)/(Expected+1)) vs Log((Control+1)/(ExpectedC+1))",
    "OERATIO": "(Observed/Expected) / (Control/ExpectedC)",
    "OERATIOV2": "Log((Observed/Expected) / (Control/ExpectedC))",
    "OERATIOP1": "((Observed+1)/(Expected+1)) / ((Control+1)/(ExpectedC+1))",
    "OERATIOP1V2": "Log(((Observed+1)/(Expected+1)) / ((Control+1)/(ExpectedC+1)))",
    "OERATIOMINUS": "(Observed/Expected) - (Control/ExpectedC)",
    "OERATIOMINUSP1": "(Observed+1)/(Expected+1) - (Control+1)/(ExpectedC+1)",
    "OCMEVS": "Observed-Expected vs Control-Expected",
    "PEARSONVS": "Observed Pearson vs Control Pearson",
    "LOGVS": "Log(Observed/AvgO+1) vs Log(Control/AvgC+1)",
    "LOGEOVS": "Log(Observed+1)/Log(Expected+1) vs Log(Control+1)/Log(ExpectedC+1)",
    "LOGRATIO": "Log(Observed/AvgO+1)/Log(Control/AvgC+1)",
    "LOGRATIOV2": "Log(Log(Observed/AvgO+1)/Log(Control/AvgC+1))",
    "LOGEORATIO": "(Log(Observed+1)/Log(Expected+1)) / (Log(Control+1)/Log(ExpectedC+1))",
    "LOGEORATIOV2": "Log((Log(Observed+1)/Log(Expected+1)) / (Log(Control+1)/Log(ExpectedC+1)))",
    "DIFF": "Observed-Control",
    "NORM": "Norm",
    "EIGENVECTOR": "Eigenvector",
    "NORM2OBSVSCTRL": "Observed Norm^2 vs Control Norm^2",
}
#: Kinds that are written as vectors and as matrices, and those on a scale around zero besides the differences.
VECTORS, MATRICES = ("NORM", "EXPECTED"), ("OE", "OBSERVED")
AROUND_ZERO = ("OEV2", "OEP1V2", "RATIOV2", "RATIOP1V2", "RATIO0V2", "RATIO0P1V2", "OECTRLV2", "OECTRLP1V2", "OEVSV2", "OEVSP1V2", "OERATIOV2", "OERATIOP1V2", "LOGRATIOV2", "LOGEORATIOV2")


def says(kind: str, *words: str) -> bool:
    """Whether the label has any of the words, in any case."""
    return any(w in LABELS[kind.upper()].lower() for w in words)


#: What is asked of a kind.
TRAITS = {
    "plain map": lambda k: k.upper() in ("OBSERVED", "CONTROL"),
    "expected values": lambda k: says(k, "expected", "probability"),
    "whole genome": lambda k: not says(k, "expected", "probability"),
    "within chromosomes only": lambda k: says(k, "pearson", "vs", "probability"),
    "control without expected values": lambda k: says(k, "control") and not says(k, "expected"),
    "correlation": lambda k: says(k, "pearson"),
    "correlation of the control": lambda k: says(k, "pearson") and says(k, "control"),
    "adjustable colors": lambda k: not says(k, "pearson"),
    "side by side": lambda k: says(k, "vs"),
    "difference": lambda k: says(k, "-"),
    "colors around zero": lambda k: k.upper() in AROUND_ZERO or says(k, "-"),
    "written as a vector": lambda k: k.upper() in VECTORS,
    "written as a matrix": lambda k: k.upper() in MATRICES,
}


def kinds_of(trait: str) -> list[str]:
    return [k for k in LABELS if TRAITS[trait](k)]
