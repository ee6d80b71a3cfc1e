"""Errors and warnings of the library, by subject."""

from __future__ import annotations


class GridloomError(Exception):
    """Base of all errors here."""


class GridloomWarning(UserWarning):
    """Base of all warnings here."""


class NoSharedFolder(GridloomError):
    """A cluster without a folder for written intermediates."""


# Tiling and filters.
class UnknownLevelError(GridloomError):
    """A pyramid level that the pipeline does not cover."""


class UnknownFilterError(GridloomError):
    """A filter that is neither registered nor callable."""


class UnknownMethodError(GridloomError):
    """A method name or filter form that is not supported."""


class InvalidArgument(GridloomError):
    """An argument outside its range."""


class HasNoDataFolder(GridloomError):
    """A project without a data folder."""


# Data sets.
class UnknownSplitModeError(GridloomError):
    """A split given in an unknown form."""


class InvalidDatasetError(GridloomError):
    """A table that is no data set, or an empty one where rows are needed."""


class MissingArgumentError(GridloomError):
    """A required argument was left out."""


class InvalidSplitError(GridloomError):
    """Sections that do not sum to one or have no names."""


class TagNotFoundError(GridloomError):
    """A class that does not occur in the data set."""


# Patch relations.
class LevelNotFoundError(GridloomError):
    """No patches at the level."""


class EmptyProjectError(GridloomError):
    """A project without patch files."""


class SlideNotFoundError(GridloomError):
    """A patch folder without its slide."""


class PatchesNotFoundError(GridloomError):
    """A folder without a patch file."""


class UnknownColumnError(GridloomError):
    """A column that the patch files do not have."""


# Regions.
class BottomLeftNotFound(GridloomError):
    """A contour without a start."""


class NextPointNotFound(GridloomError):
    """A contour that cannot be followed."""


class NoPathFound(GridloomError):
    """A contour that does not return to its start."""


class OutOfBound(GridloomError):
    """A value outside all bins."""


# Graphs and trees.
class InvalidNodeProps(GridloomError):
    """Node properties in a form that cannot be stored."""


class InvalidEdgeProps(GridloomError):
    """Edge properties in a form that cannot be stored."""


class UndefinedParenthood(GridloomError):
    """A tree without parents."""


class UndefinedChildhood(GridloomError):
    """A tree without children."""


class InvalidTree(GridloomError):
    """Parents and children that contradict each other."""


class UnknownNodeProperty(GridloomError):
    """A node property that the tree does not have."""


class InvalidNodeId(GridloomError):
    """An edge to a node that the graph does not have."""


class UnrelatedNode(GridloomError):
    """Nodes without a common ancestor, or the root itself."""


class UnreachableAncestor(GridloomError):
    """A node that is no ancestor of the other."""
